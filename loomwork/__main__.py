"""python -m loomwork list | show NAME DIR | write NAME DIR PATH | sql NAME | plan NAME DIR"""

from __future__ import annotations

import sys

from .plans.catalog import QUERIES
from .plans.oracle import ORACLE
from .session import session


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    if len(args) < 2 or args[1] not in QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    if args[0] == "sql":
        print(ORACLE[args[1]])
        return 0
    df = QUERIES[args[1]](session(), args[2])
    if args[0] == "show":
        df.show(20, truncate=60)
    elif args[0] == "plan":
        df.explain("formatted")
    else:
        df.write.mode("overwrite").parquet(args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
