"""Stages of a workflow on the driver: what is done is told by fingerprints, and a change undoes what follows."""

from __future__ import annotations

import hashlib
import json
import os

#: The stages in order.
STAGES = ("config", "scan", "extract", "evidence", "package", "translate", "structural-review", "reconcile", "language-qa", "validate", "rebuild", "install-dry-run", "install")


def fingerprint(value: object) -> str:
    """SHA-256 of canonical JSON: sorted keys, compact, characters as they are."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def load(path: str) -> dict:
    if not os.path.exists(path):
        return {s: {"status": "not-started"} for s in STAGES}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def save(path: str, state: dict) -> None:
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(state, f, sort_keys=True, ensure_ascii=False)
    os.replace(f"{path}.tmp", path)


def digest(path: str) -> str | None:
    """SHA-256 of a file, None where there is none."""
    if not os.path.isfile(path):
        return None
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def reusable(state: dict, stage: str, print_: str) -> bool:
    """Done, for the same inputs, and with its artifact as it was written."""
    own = state[stage]
    return own.get("status") == "done" and own.get("fingerprint") == print_ and own.get("sha256") is not None and own["sha256"] == digest(own["artifact"])


def finish(state: dict, stage: str, print_: str, artifact: str) -> dict:
    """The stage is done; if its fingerprint is new, the stages after it are not."""
    changed = state[stage].get("fingerprint") != print_
    out = {**state, stage: {"status": "done", "fingerprint": print_, "artifact": artifact, "sha256": digest(artifact)}}
    return invalidate(out, STAGES[STAGES.index(stage) + 1]) if changed and stage != STAGES[-1] else out


def invalidate(state: dict, stage: str) -> dict:
    return {s: {"status": "not-started"} if STAGES.index(s) >= STAGES.index(stage) else state[s] for s in STAGES}
