"""The queries of the catalogue as SQL over the same tables."""

from __future__ import annotations

PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS source_text,
 CASE u.conv_id % 10 WHEN 0 THEN u.text WHEN 1 THEN '' WHEN 2 THEN '<LSTag Type=''x''>' || a.text || '</LSTag>' WHEN 3 THEN '<LSTag>' || a.text WHEN 4 THEN a.text || '< / lstag a>' WHEN 5 THEN a.text || ' <LSTag Type' WHEN 6 THEN a.text || '<LSTag/>' ELSE a.text END AS target_text,
 ['dialogue_general', 'dialogue_story', 'quest', 'bark', 'ui', 'skill_spell', 'item', 'book_lore', 'character_world', 'system_message', 'tutorial', 'other', 'unheard-of'][u.conv_id % 13 + 1] AS category
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""
ATTEMPTS = """attempts AS (SELECT event_id, user_id, event_id % 100 AS item, ts, event_type, value,
 CASE WHEN event_type IN ('purchase', 'signup') THEN 'succeeded' WHEN event_type = 'error' THEN 'failed-final' WHEN event_type = 'click' THEN 'failed-retryable' ELSE 'running' END AS outcome,
 CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""
FOLDED = (
    ATTEMPTS
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS rn,
 count(*) OVER (PARTITION BY user_id, item) AS attempt_count, count(*) FILTER (outcome = 'succeeded') OVER (PARTITION BY user_id, item) AS n_succeeded FROM attempts),
 folded AS (SELECT user_id, item, attempt_count, n_succeeded, ts AS last_ts, event_id AS last_event_id, outcome AS last_outcome,
 CASE WHEN outcome = 'succeeded' THEN 'succeeded' WHEN outcome = 'running' THEN 'running' WHEN outcome = 'failed-retryable' AND attempt_count < 3 THEN 'failed-retryable' ELSE 'failed-final' END AS status FROM ranked WHERE rn = 1)"""
)
REUSE = """r AS (SELECT p_partkey, p_name || '|' || p_brand AS text, p_type AS target FROM part),
 idx AS (SELECT text, count(*) AS n_shared, count(DISTINCT target) AS n_targets FROM r WHERE p_partkey % 5 <> 0 GROUP BY text),
 classes AS (SELECT r.p_partkey, r.text AS source_text, CASE WHEN n_shared IS NULL THEN 'none' WHEN n_targets > 1 THEN 'conflict' WHEN n_shared = 1 THEN 'single' ELSE 'consensus' END AS reuse_class,
 coalesce(n_shared, 0) AS n_shared, coalesce(n_targets, 0) AS n_targets FROM r LEFT JOIN idx ON idx.text = r.text WHERE r.p_partkey % 5 = 0)"""
QA = (
    PAIRS
    + r""", q0 AS (SELECT *, regexp_replace(regexp_replace(source_text, '^\s+', ''), '\s+$', '') AS s, regexp_replace(regexp_replace(coalesce(target_text, ''), '^\s+', ''), '\s+$', '') AS t FROM pairs),
 q1 AS (SELECT *, length(s) AS n, length(t) AS m, category <> 'unheard-of' AS known, CASE category WHEN 'bark' THEN 12 WHEN 'ui' THEN 8 ELSE 20 END AS least,
 CASE WHEN category IN ('bark', 'ui') THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END AS lo, CASE WHEN category IN ('bark', 'ui') THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END AS hi,
 regexp_extract_all(target_text, '(?i)<\s*/?\s*LSTag\b[^>]*>') AS tags, len(regexp_extract_all(target_text, '(?i)<\s*/?\s*LSTag\b')) AS marks,
 list_transform(regexp_extract_all(target_text, '(?i)<\s*/?\s*LSTag\b[^>]*>'), lambda x: CASE WHEN regexp_matches(x, '^<\s*/') THEN -1 WHEN regexp_matches(x, '/\s*>$') THEN 0 ELSE 1 END) AS steps,
 list_sort(regexp_extract_all(source_text, '(\{[^{}]+\}|%(?:[0-9]+\$)?[sdif])', 1)) AS want, list_sort(regexp_extract_all(coalesce(target_text, ''), '(\{[^{}]+\}|%(?:[0-9]+\$)?[sdif])', 1)) AS got FROM q0),
 q2 AS (SELECT *, list_filter([CASE WHEN NOT known THEN 'CATEGORY_RULE_MISSING' END, CASE WHEN m = 0 THEN 'OUTPUT_EMPTY' END,
 CASE WHEN len(list_filter(list_distinct(want), lambda x: len(list_filter(want, lambda y: y = x)) > len(list_filter(got, lambda y: y = x)))) > 0 THEN 'PROTECTED_TOKEN_MISSING' END,
 CASE WHEN len(list_filter(list_distinct(got), lambda x: len(list_filter(got, lambda y: y = x)) > len(list_filter(want, lambda y: y = x)))) > 0 THEN 'PROTECTED_TOKEN_ADDED' END,
 CASE WHEN marks > len(tags) OR len(list_filter(tags, lambda x: regexp_matches(x, '(?i)^<\s*/\s*LSTag\b\s*[^\s>]'))) > 0 OR coalesce(list_sum(steps), 0) <> 0
  OR len(list_filter(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]) < 0)) > 0 THEN 'LSTAG_MALFORMED' END,
 CASE WHEN known AND n > 0 AND m > 0 AND s = t AND regexp_matches(s, '[A-Za-z]{4,}') THEN 'SOURCE_EQUALS_TARGET' END,
 CASE WHEN known AND n >= least AND m > 0 AND (m::DOUBLE / n < lo OR m::DOUBLE / n > hi) THEN 'LENGTH_RATIO_SUSPICIOUS' END], lambda x: x IS NOT NULL) AS issues FROM q1),
judged AS (SELECT *, CASE WHEN NOT known THEN 'FAIL' WHEN list_has_any(issues, ['OUTPUT_EMPTY', 'PROTECTED_TOKEN_MISSING', 'PROTECTED_TOKEN_ADDED', 'LSTAG_MALFORMED']) THEN 'RETRY' WHEN len(issues) > 0 THEN 'REVIEW' ELSE 'PASS' END AS route FROM q2),
 results AS (SELECT conv_id, turn, route, md5(target_text) AS output_hash, CASE WHEN turn % 4 = 0 THEN 'v1' ELSE 'v2' END AS ruleset FROM judged),
 states AS (SELECT conv_id, turn, category, CASE WHEN conv_id % 13 = 0 THEN target_text || '!' ELSE target_text END AS output FROM pairs),
 staleness AS (SELECT r.conv_id, r.turn, r.route, r.output_hash <> md5(s.output) OR r.ruleset <> 'v2' AS is_stale FROM results r JOIN states s USING (conv_id, turn))"""
)
COMPLETION = (
    QA
    + """, st AS (SELECT *, md5(output) AS output_hash, CASE WHEN turn % 6 = 5 THEN 'running' WHEN conv_id % 17 = 3 THEN 'failed-retryable' WHEN conv_id % 19 = 4 THEN 'failed-final' ELSE 'succeeded' END AS status FROM states),
 view AS (SELECT st.conv_id, st.turn, st.category, CASE WHEN status = 'running' THEN 'WAITING_TRANSLATION/EXECUTION_RUNNING' WHEN status = 'failed-retryable' THEN 'WAITING_RETRY/EXECUTION_FAILED_RETRYABLE'
 WHEN status = 'failed-final' THEN 'BLOCKED/EXECUTION_FAILED_FINAL' WHEN output = '' THEN 'BLOCKED/SUCCEEDED_OUTPUT_MISSING' WHEN route IS NULL THEN 'BLOCKED/QA_RESULT_MISSING'
 WHEN r.output_hash <> st.output_hash OR ruleset <> 'v2' THEN 'BLOCKED/QA_RESULT_STALE' WHEN route = 'PASS' THEN 'MERGE_READY/READY' WHEN route = 'RETRY' THEN 'WAITING_RETRY/QA_RETRY'
 WHEN route = 'REVIEW' AND st.conv_id % 2 = 0 THEN 'MERGE_READY/HUMAN_REVIEW_ACCEPTED' WHEN route = 'REVIEW' THEN 'WAITING_REVIEW/QA_REVIEW' ELSE 'BLOCKED/QA_FAIL' END AS found
 FROM st LEFT JOIN (SELECT * FROM results WHERE conv_id % 23 <> 6) r USING (conv_id, turn)),
 completion AS (SELECT conv_id, turn, category, split_part(found, '/', 1) AS disposition, split_part(found, '/', 2) AS reason FROM view)"""
)
UNIVERSE = """universe AS (SELECT d.doc_id, d.lang, count(*) OVER (PARTITION BY md5(d.text)) AS copies, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
 parted AS (SELECT *, CASE WHEN toxic = 1 THEN 'context-hold' WHEN quality IS NOT NULL THEN 'existing-authority' WHEN copies > 1 THEN 'cross-domain' WHEN lang <> 'en' THEN 'source-unconfirmed' ELSE 'new-target' END AS universe_class FROM universe)"""
CANDIDATES = """cand AS (SELECT p_partkey, u.* FROM part, LATERAL (SELECT * FROM (VALUES
 (CASE WHEN starts_with(p_type, 'PROMO') THEN 'bark' END, 'high', 0, 10), (CASE WHEN p_size > 40 THEN 'quest' END, 'medium', 1, 20), (CASE WHEN ends_with(p_brand, '1') THEN 'item' END, 'high', 0, 40),
 (CASE WHEN p_retailprice > 990 THEN 'skill_spell' END, 'medium', 1, 30), (CASE WHEN p_size < 10 THEN 'ui' END, 'low', 2, 50)) v(category, confidence, c, p) WHERE category IS NOT NULL) u),
 best AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY c, p) AS rn FROM cand),
 owners AS (SELECT part.p_partkey, b.category AS primary_category, b.confidence,
 coalesce((SELECT string_agg('also:' || o.category, ';' ORDER BY o.category) FROM cand o WHERE o.p_partkey = part.p_partkey AND o.category <> b.category), '') AS tags,
 CASE WHEN b.category IS NULL THEN 'unresolved' ELSE 'classified' END AS status FROM part LEFT JOIN best b ON b.p_partkey = part.p_partkey AND b.rn = 1)"""
METERED = (
    ATTEMPTS
    + """, metered AS (SELECT user_id, event_type AS model, 'p' || CAST(user_id % 3 AS VARCHAR) AS provider, outcome, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) AS attempt_number,
 CASE WHEN event_id % 10 > 0 THEN k * 1000 + event_id % 1000 END AS p, CASE WHEN event_id % 7 > 0 THEN k * 100 + event_id % 10 END AS q, CASE WHEN event_id % 5 > 0 AND event_id % 10 > 0 AND event_id % 7 > 0 THEN k * 1100 + event_id % 1000 + event_id % 10 END AS t FROM attempts)"""
)
SPENT = (
    METERED
    + """, spent AS (SELECT m.provider, m.model, count(*) AS n_ended, count(coalesce(p, q, t)) AS n_known, CAST(coalesce(sum(p), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(q), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(t), 0) AS BIGINT) AS total_tokens,
 CASE WHEN any_value(pi) IS NULL THEN 0 ELSE count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) END AS n_priced, any_value(pi) * coalesce(sum(p) FILTER (q IS NOT NULL), 0) AS i, any_value(po) * coalesce(sum(q) FILTER (p IS NOT NULL), 0) AS o
 FROM metered m LEFT JOIN (VALUES ('p0', 'click', 1250000::HUGEINT, 5000000::HUGEINT), ('p0', 'purchase', 10000000, 30500000), ('p1', 'purchase', 125, 2000000), ('p2', 'signup', 3000000, 15000000)) x(provider, model, pi, po) ON x.provider = m.provider AND x.model = m.model WHERE outcome <> 'running' GROUP BY m.provider, m.model)"""
)
#: A sum in units of a million millionth, as a decimal text.
MONEY = "CAST({0} // 1000000000000 AS VARCHAR) || '.' || lpad(CAST({0} % 1000000000000 AS VARCHAR), 12, '0')"
HITS = r"""raw AS (SELECT p_partkey AS k, p_partkey % 700 AS uid, ['bark-speaker', 'quest-journal', 'ui-skill-candidate', 'stat-reference', 'story-occurrence', 'ui-skill-universe', 'dialog-context', 'plain', 'story-occurrence'][p_partkey % 9 + 1] AS mt,
 ['AbilityOrSkill', 'ItemsAndEquipment', 'UserInterface', 'x', ''][p_partkey % 5 + 1] AS md FROM part WHERE p_partkey % 4 <> 3 OR p_partkey % 700 % 5 = 0),
 ev0 AS (SELECT *, k * 7 + 5 * j + k // 11 AS h FROM raw, (VALUES (0), (1)) v(j)),
 ev AS (SELECT k, uid, mt, md, j, 'R' || CAST(h % 3 AS VARCHAR) AS rule_id,
 ['BarkSpeakerStructure', 'QuestJournal', 'UiSkillProvider', 'StatsDefinition', 'PassiveContext', 'StoryOccurrence', 'UiSkillUniverse', 'DialogGraph', 'StoryOccurrence', 'UiSkillUniverse', 'Nothing'][h % 11 + 1] AS et,
 ['Public\Stats\Spells.txt', 'a/Weapons.lsx', 'Localization/levels.lsx', 'x/Foo_SubRegions.lsx', 'ReadyChecks_Descriptions.x', 'ItemCombinations', 'Localization\Stats\any.lsx', 'status_boosts.loca', 'deep/shout_x', 'plain.txt'][(h // 11) % 10 + 1] AS path,
 ['skill_spell', 'item', NULL, NULL][h % 4 + 1] AS by_entry, ['AbilityOrSkill', 'ItemsAndEquipment', 'UserInterface', 'x', ''][h % 5 + 1] AS pd, h % 5 AS fam, h % 3 > 0 AS content, h % 17 = 0 AS old, h % 13 = 0 AS excluded, h % 6 AS ws, h % 2 AS dm, h % 4 < 3 AS display FROM ev0),
 st AS (SELECT *, regexp_replace(split_part(replace(lower(path), '\', '/'), '/', -1), '\.[^.]*$', '') AS stem FROM ev),
 head AS (SELECT k, uid, mt, md, arg_min(rule_id, j) FILTER (et = 'BarkSpeakerStructure') AS rb, arg_min(path, j) FILTER (et = 'BarkSpeakerStructure') AS pb, arg_min(rule_id, j) FILTER (et = 'QuestJournal') AS rq, arg_min(path, j) FILTER (et = 'QuestJournal') AS pq,
  arg_min(rule_id, j) FILTER (et = 'UiSkillProvider') AS ru, arg_min(path, j) FILTER (et = 'UiSkillProvider') AS pu, arg_min(rule_id, j) FILTER (et = 'DialogGraph') AS rd, arg_min(path, j) FILTER (et = 'DialogGraph') AS pdg FROM st GROUP BY ALL),
 ui(d, c) AS (VALUES ('AbilityOrSkill', 'skill_spell'), ('ItemsAndEquipment', 'item'), ('UserInterface', 'ui')),
 hits(uid, category, confidence, reason, rule_id, resource_path) AS (
 SELECT uid, 'bark', 'high', 'bark-structural-mapping', coalesce(rb, 'bark-structural-mapping'), coalesce(pb, '') FROM head WHERE mt = 'bark-speaker' OR rb IS NOT NULL
 UNION ALL SELECT uid, 'quest', 'high', 'quest-journal-mapping', coalesce(rq, 'quest-journal-mapping'), coalesce(pq, '') FROM head WHERE mt = 'quest-journal' OR rq IS NOT NULL
 UNION ALL SELECT uid, c, 'high', 'ui-skill-domain', coalesce(ru, 'ui-skill-domain'), coalesce(pu, '') FROM head JOIN ui ON d = md WHERE mt = 'ui-skill-candidate'
 UNION ALL SELECT uid, 'dialogue_general', 'high', 'dialog-context', coalesce(rd, 'dialog-context'), coalesce(pdg, '') FROM head WHERE mt = 'dialog-context' OR rd IS NOT NULL
 UNION ALL SELECT uid, coalesce(by_entry, s.c), CASE WHEN by_entry IS NOT NULL THEN 'high' ELSE 'medium' END, CASE WHEN by_entry IS NOT NULL THEN 'stat-entry-type' ELSE 'stat-resource-path' END, rule_id, path
  FROM st LEFT JOIN (VALUES ('spells', 'skill_spell'), ('weapons', 'item')) s(n, c) ON s.n = stem WHERE (mt = 'stat-reference' OR et IN ('StatsDefinition', 'PassiveContext')) AND (by_entry IS NOT NULL OR s.c IS NOT NULL)
 UNION ALL SELECT uid, c, 'high', 'ui-skill-provider', rule_id, path FROM st JOIN ui ON d = pd WHERE et = 'UiSkillProvider'
 UNION ALL SELECT uid, split_part(f, '/', 1), 'high', split_part(f, '/', 2), rule_id, path FROM (SELECT *, CASE WHEN fam = 0 AND content THEN 'book_lore/readable-registry-structure' WHEN fam = 1 THEN 'character_world/tags-characters-structure' WHEN fam = 3 THEN 'dialogue_general/story-dialog-structure'
   WHEN fam IN (2, 4) AND content THEN CASE WHEN stem IN ('levels', 'foo_subregions') THEN 'character_world/world-registry-structure' WHEN stem = 'readychecks_descriptions' THEN 'system_message/ready-check-registry-structure'
   WHEN stem = 'itemcombinations' THEN 'item/item-combination-registry-structure' WHEN stem IN ('any', 'status_boosts', 'shout_x') THEN 'skill_spell/gameplay-registry-structure' END END AS f FROM st WHERE mt = 'story-occurrence' AND et = 'StoryOccurrence' AND NOT old) WHERE f IS NOT NULL
 UNION ALL SELECT uid, split_part(f, '/', 1), 'high', split_part(f, '/', 2), rule_id, path FROM (SELECT *, CASE ws WHEN 0 THEN 'item/ui-skill-workstream' WHEN 1 THEN 'skill_spell/ui-skill-workstream' WHEN 2 THEN 'ui/ui-skill-workstream' WHEN 3 THEN CASE WHEN dm = 0 THEN 'tutorial/tutorial-workstream-domain' END
   WHEN 4 THEN CASE WHEN dm = 1 AND display THEN 'skill_spell/action-resource-definition' END END AS f FROM st WHERE mt = 'ui-skill-universe' AND et = 'UiSkillUniverse' AND NOT excluded) WHERE f IS NOT NULL)"""
PLAN = """o AS (SELECT o_orderkey, o_orderpriority AS category, o_custkey % 150 AS grp, CASE WHEN o_orderpriority = '1-URGENT' THEN 15 WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 50 ELSE 100 END AS lim FROM orders),
 w AS (SELECT *, row_number() OVER (PARTITION BY category, grp ORDER BY o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY category, grp) AS size FROM o),
 u AS (SELECT *, place // lim AS part, CASE WHEN size > lim THEN grp || '#part-' || lpad(CAST(place // lim + 1 AS VARCHAR), 4, '0') ELSE CAST(grp AS VARCHAR) END AS unit FROM w),
 sized AS (SELECT category, grp, part, unit, lim, count(*) AS n FROM u GROUP BY ALL),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY grp, part) AS i FROM sized),
 fit(category, unit, i, filled, b) AS (SELECT category, unit, i, n, 1 FROM numbered WHERE i = 1 UNION ALL
 SELECT x.category, x.unit, x.i, CASE WHEN f.filled + x.n > x.lim THEN x.n ELSE f.filled + x.n END, CASE WHEN f.filled + x.n > x.lim THEN f.b + 1 ELSE f.b END FROM fit f JOIN numbered x ON x.category = f.category AND x.i = f.i + 1),
 plan AS (SELECT u.o_orderkey, u.category, u.unit, u.category || '-' || lpad(CAST(f.b AS VARCHAR), 4, '0') AS batch_id FROM u JOIN fit f ON f.category = u.category AND f.unit = u.unit),
 manifest AS (SELECT category, batch_id, count(*) AS n_records, count(DISTINCT unit) AS n_units, min(o_orderkey) AS first_key FROM plan GROUP BY ALL)"""
EDGES = """edges AS (SELECT n_nationkey AS a, CAST((n_nationkey * 3 + 1) % 25 AS INTEGER) AS b FROM nation UNION SELECT n_nationkey, CAST((n_nationkey + 7) % 25 AS INTEGER) FROM nation),
 walk(start, node, depth) AS (SELECT a, b, 1 FROM edges WHERE a <> b UNION SELECT w.start, e.b, w.depth + 1 FROM walk w JOIN edges e ON e.a = w.node WHERE w.depth < 24 AND e.b <> w.start),
 closure AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY ALL)"""
EDITS = """edits AS (SELECT p_partkey, CASE WHEN p_partkey % 20 = 3 THEN p_name || '*' ELSE p_name END AS p_name FROM part WHERE p_partkey % 10 = 3 UNION ALL SELECT -p_partkey, p_name FROM part WHERE p_partkey % 10 = 7),
 merged AS (SELECT coalesce(b.p_partkey, e.p_partkey) AS p_partkey, coalesce(e.p_name, b.p_name) AS p_name, b.p_name AS old, e.p_name AS new,
 CASE WHEN b.p_partkey IS NULL THEN 'append' WHEN e.p_partkey IS NULL THEN 'keep' WHEN e.p_name <> b.p_name THEN 'update' ELSE 'unchanged' END AS action FROM part b FULL JOIN edits e ON e.p_partkey = b.p_partkey)"""
TOKENS = r"regexp_extract_all(html, '(\{[^{}]+\}|%(?:[0-9]+\$)?[sdif])', 1)"
MINUS = "array_to_string(flatten(list_transform(list_sort(list_distinct({a})), lambda x: list_transform(range(greatest(0, len(list_filter({a}, lambda y: y = x)) - len(list_filter({b}, lambda y: y = x)))), lambda z: x))), ',')"


def _percent(part: str, total: str) -> str:
    return f"coalesce(round_even(100.0::DOUBLE * {part} / nullif({total}, 0), 2), 0.0::DOUBLE)"


BATCH_SOURCES = (
    r"""p AS (SELECT *, 'U' || p_partkey AS uid, p_partkey AS k, ['dialogue_general', 'quest', 'skill_spell', 'item', 'ui', 'tutorial', 'book_lore', 'character_world', 'system_message'][p_partkey % 9 + 1] AS category FROM part),
 led AS (SELECT uid, CASE WHEN k % 2 = 0 THEN 'dialog:' || lower(p_brand) WHEN k % 3 = 0 THEN 'story:mods/story/goals/' || lower(p_brand) || '.lsj|node' || p_size ELSE 'path:mods/story/goals/' || lower(p_brand) || '.lsj' END AS c, CASE WHEN k % 3 = 0 THEN 'node' || p_size ELSE '' END || '|title' AS s FROM p WHERE k % 5 < 2),
 uis AS (SELECT uid, CASE WHEN k % 6 = 0 THEN 'entity:' || lower(p_brand) || '|' || lower(p_type) WHEN k % 3 = 0 THEN 'entity:' || lower(p_brand) ELSE 'path:' || lower(p_brand) END AS c, CASE WHEN k % 2 = 0 THEN lower(p_type) END AS s FROM p WHERE k % 7 < 3 AND k % 14 <> 0),
 res AS (SELECT uid, CASE WHEN k % 2 = 0 THEN 'stat:' || lower(p_brand) || '|' || lower(p_type) WHEN k % 3 = 0 THEN 'quest:' || lower(p_brand) || '|' || lower(p_type) ELSE 'quest:' || lower(p_brand) || '|element:' || p_size END AS c, CASE WHEN k % 2 = 0 THEN lower(p_brand) ELSE 'role' END AS s FROM p WHERE k % 11 < 4),
 src AS (SELECT p.uid, category, led.c AS lc, led.s AS ls, uis.c AS uc, uis.s AS us, res.c AS rc, res.s AS rs, CASE WHEN k % 4 = 0 THEN list_sort(['path:mods/a.lsf', 'path:' || lower(p_brand)]) ELSE [] END AS e FROM p LEFT JOIN led USING (uid) LEFT JOIN uis USING (uid) LEFT JOIN res USING (uid)),
 got AS (SELECT uid, category, CASE WHEN category = 'dialogue_general' THEN one(lc) WHEN category IN ('book_lore', 'character_world') THEN CASE WHEN lc IS NOT NULL THEN [lc] ELSE e END WHEN category = 'quest' THEN CASE WHEN rc IS NOT NULL THEN [rc] ELSE e END
 WHEN category = 'skill_spell' THEN CASE WHEN rc IS NOT NULL THEN [rc] WHEN uc IS NOT NULL THEN [uc] ELSE e END WHEN category IN ('item', 'ui', 'tutorial') THEN CASE WHEN uc IS NOT NULL THEN [uc] WHEN rc IS NOT NULL THEN [rc] ELSE e END WHEN len(e) > 0 THEN e ELSE one(lc) END AS c,
 CASE WHEN category IN ('dialogue_general', 'book_lore', 'character_world') THEN one(ls) WHEN category = 'quest' THEN one(rs) WHEN category = 'skill_spell' THEN CASE WHEN rc IS NOT NULL THEN one(rs) ELSE one(us) END WHEN category IN ('item', 'ui', 'tutorial') THEN CASE WHEN uc IS NOT NULL THEN one(us) ELSE one(rs) END ELSE [] END AS s FROM src),
 grouped AS (SELECT *, CASE WHEN len(c) > 0 THEN c[1] ELSE 'uid:' || lower(uid) END AS group_key FROM got)"""
)
for _x in ("lc", "ls", "us", "rs"):
    BATCH_SOURCES = BATCH_SOURCES.replace(f"one({_x})", f"list_filter([{_x}], lambda x: x IS NOT NULL)")
ENTRIES = """entries AS (SELECT DISTINCT ['Game.pak', 'Gustav.pak', 'GustavX.pak', 'Patch8_HotFix9.pak', 'Shared.pak', 'Other.pak'][p_partkey // 3 % 6 + 1] AS package, p_partkey // 5 % 10 AS f, ['Honour', 'Shared', 'SharedDev', 'Game', 'Gustav'][p_partkey % 5 + 1] AS m,
 'Public/' || ['Honour', 'Shared', 'SharedDev', 'Game', 'Gustav'][p_partkey % 5 + 1] || '/' || p_partkey // 50 || '/' || ['Stats/Generated/Data/Spell_Projectile.txt', 'Stats/Generated/Data/Passive.txt', 'Stats/Generated/Data/Status_BOOST.txt', 'GUI/Tutorial_Main.xaml', 'RootTemplates/x.lsf', 'Story/RawFiles/Goals/MessageBox.txt', 'GUI/Inventory.xaml', 'Lists/Feats.lsx', 'notes.md', 'a/../ActionResource.lsx'][p_partkey // 5 % 10 + 1] AS internal_path FROM part)"""
DEFINITIONS = """d AS (SELECT p_partkey AS id, p_size % 2 AS provider, p_partkey // 2 AS name, CASE WHEN p_size % 4 = 0 THEN 'A' WHEN p_size % 4 = 3 THEN 'B' ELSE '' END AS t, CASE WHEN p_partkey % 3 > 0 THEN p_partkey // 4 END AS up, p_name AS f FROM part)"""
RETURNED = r"""base AS (SELECT p_partkey AS k, CASE WHEN k % 2 = 0 THEN p_name || ' {x}' WHEN k % 7 = 0 THEN '<LSTag>' || p_name || '</LSTag>' ELSE p_name END AS src, p_size, k % 5 > 0 AS need, k % 3 > 0 AS src_only FROM part),
 cand AS (SELECT *, CASE k % 12 WHEN 0 THEN '' WHEN 1 THEN src || ' {y}' WHEN 2 THEN 'plain' WHEN 3 THEN '<LSTag>open' ELSE src END AS t, CASE WHEN k % 6 = 0 THEN 'skip' WHEN k % 13 = 0 THEN 'more' WHEN k % 17 = 0 THEN 'escalate' WHEN k % 19 = 0 THEN '' ELSE 'done' END AS st FROM base),
 back AS (SELECT *, CAST(k AS VARCHAR) AS uid, 0 AS part_no, true AS known FROM cand WHERE k % 47 > 0 UNION ALL SELECT *, CAST(k AS VARCHAR), 1, true FROM cand WHERE k % 41 = 0 UNION ALL SELECT *, 'x' || k, 0, false FROM cand WHERE k % 43 = 0),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY part_no) = 1 AS fresh FROM back),
 bits AS (SELECT *, known AND fresh AS ok, t LIKE '%{x}%' AS has_x, k % 2 = 0 AS want_x, t LIKE '%{y}%' AS has_y, k % 12 = 3 AS broken, k % 2 = 1 AND k % 7 = 0 AS tagged FROM ranked),
 checked AS (SELECT uid AS ContentUid, part_no, list_filter([CASE WHEN NOT known THEN 'VAL001' END, CASE WHEN known AND NOT fresh THEN 'VAL002' END, CASE WHEN ok AND k % 23 = 0 THEN 'VAL003' END, CASE WHEN ok AND k % 29 = 0 THEN 'VAL004' END, CASE WHEN ok AND k % 31 = 0 THEN 'VAL005' END,
 CASE WHEN ok AND t <> '' AND want_x AND NOT has_x THEN 'VAL006' END, CASE WHEN ok AND t <> '' AND (has_y OR has_x AND NOT want_x) THEN 'VAL007' END, CASE WHEN ok AND t <> '' AND (broken OR src_only AND tagged AND NOT t LIKE '%</LSTag>%') THEN 'VAL008' END,
 CASE WHEN ok AND t = '' AND need AND st NOT IN ('', 'skip') THEN 'VAL009' END, CASE WHEN ok AND k % 37 = 0 THEN 'VAL011' END], lambda x: x IS NOT NULL) AS e,
 CASE WHEN ok AND st = 'more' THEN 'VAL102' WHEN ok AND st = 'escalate' THEN 'VAL103' ELSE '' END AS warnings, t <> '' OR (st = 'skip' AND need) AS takes, need, ok FROM bits)"""
JUDGED_STATES = """s9 AS (SELECT conv_id || '-' || turn AS uid, conv_id, category, CASE WHEN turn % 6 = 5 THEN 'running' ELSE 'succeeded' END AS status, output, md5(output) AS output_hash, conv_id % 4 AS tries FROM states),
 r9 AS (SELECT conv_id || '-' || turn AS uid, route, ruleset, output_hash FROM results)"""

LAYERS = """layers AS (SELECT CAST(o_custkey AS VARCHAR) AS name, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'base-' || CAST(o_orderkey % 5 AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS "using", o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
 stops AS (SELECT name, count(*) AS n_layers, min(rn) FILTER (o IS NOT NULL) AS stop FROM (SELECT name, rn, CASE WHEN "using" <> name THEN 1 END AS o FROM layers) GROUP BY name),
 walked AS (SELECT l.* FROM layers l JOIN stops s ON s.name = l.name WHERE s.stop IS NULL OR l.rn <= s.stop),
 brought AS (SELECT name, o_orderkey, rn, 'priority' AS field, o_orderpriority AS value FROM walked WHERE o_orderkey % 3 = 0 UNION ALL SELECT name, o_orderkey, rn, 'status' AS field, o_orderstatus AS value FROM walked UNION ALL SELECT name, o_orderkey, rn, 'day' AS field, day AS value FROM walked WHERE o_orderkey % 2 = 0)"""
FAMILY = """ent AS (SELECT CAST(doc_id AS VARCHAR) AS entity, CASE WHEN doc_id = 0 THEN '' WHEN doc_id = 8 THEN '16' WHEN doc_id % 50 = 7 THEN 'gone-' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id // 2 AS VARCHAR) END AS up FROM documents),
 own AS (SELECT CAST(doc_id AS VARCHAR) AS entity, 'lang' AS field, lang AS value FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'source', source FROM documents WHERE doc_id % 11 = 5 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'size', CAST(n_chars AS VARCHAR) FROM documents WHERE doc_id % 29 = 8),
 walk(entity, node, depth, path) AS (SELECT entity, entity, CAST(0 AS BIGINT), [entity] FROM ent UNION ALL SELECT w.entity, e.up, w.depth + 1, list_append(w.path, e.up) FROM walk w JOIN ent e ON e.entity = w.node JOIN ent p ON p.entity = e.up WHERE NOT list_contains(w.path, e.up))"""
RUNTIME = """defs AS (SELECT p_partkey AS k, 'd' || CAST(p_partkey AS VARCHAR) AS id, 'n' || CAST(p_partkey // 8 AS VARCHAR) AS name, CASE WHEN p_partkey % 5 > 0 THEN 'A' ELSE '' END AS ty, CASE p_partkey % 4 WHEN 0 THEN 'n' || CAST(p_partkey // 8 AS VARCHAR) WHEN 1 THEN 'n' || CAST(p_partkey // 8 + 1 AS VARCHAR) WHEN 2 THEN 'n' || CAST(p_partkey // 8 - 3 AS VARCHAR) ELSE '' END AS us, CASE WHEN p_partkey % 16 < 8 THEN 'x' ELSE p_type END AS f, p_size % 5 AS pr, CASE WHEN p_size % 7 <> 0 AND (p_size % 25) % 9 <> 8 THEN p_size % 25 END AS mo FROM part),
 near AS (SELECT DISTINCT a, b FROM edges WHERE a <> b), far AS (SELECT start AS a, node AS b FROM closure WHERE depth <= 2),
 pairs AS (SELECT c.id AS cid, c.name = c.us AS itself, c.mo AS cmo, c.ty || '~' || c.us || '~' || c.f AS csays, o.ty || '~' || o.us || '~' || o.f AS says, o.id AS oid, o.mo AS omo, o.pr = c.pr AS same, n.a IS NOT NULL AS near, r.a IS NOT NULL AND n.a IS NULL AS far FROM defs c JOIN defs o ON o.name = c.us AND o.id <> c.id AND (c.ty = '' OR o.ty = '' OR c.ty = o.ty) LEFT JOIN near n ON n.a = c.mo AND n.b = o.mo LEFT JOIN far r ON r.a = c.mo AND r.b = o.mo WHERE c.k % 8 < 6),
 agg AS (SELECT cid, count(*) AS n, count(*) FILTER (same) AS ns, count(*) FILTER (near) AS nd, count(*) FILTER (far) AS nt, count(DISTINCT says) AS says, count(*) FILTER (says <> csays) AS differ, count(*) FILTER (omo IS NULL) AS bare, min(oid) AS any_id, min(oid) FILTER (same) AS same_id, min(oid) FILTER (near) AS near_id, min(oid) FILTER (far) AS far_id FROM pairs GROUP BY cid),
 runtime AS (SELECT c.id AS child_id, c.name = c.us AS itself, coalesce(n, 0) AS n_candidates, any_id, same_id, near_id, far_id, CASE WHEN n IS NULL THEN 'InheritedReferenceMissingParent' WHEN c.name <> c.us AND ns = 1 THEN 'ResolvedSameProviderDefinition' WHEN c.name <> c.us AND n = 1 THEN 'ResolvedUniqueCompatibleDefinition' WHEN c.name <> c.us AND says = 1 THEN 'EquivalentProviderDefinition' WHEN c.name <> c.us THEN 'AmbiguousMultipleDefinitions' WHEN c.mo IS NULL THEN 'MetadataDoesNotCoverProvider' WHEN nd = 1 THEN 'ResolvedByDirectModuleDependency' WHEN nd = 0 AND nt = 1 THEN 'ResolvedByTransitiveModuleDependency' WHEN nd + nt > 0 THEN 'AmbiguousMultiplePriorProviders' WHEN differ = 0 THEN 'EquivalentProviderDefinition' WHEN bare > 0 THEN 'MetadataDoesNotCoverProvider' ELSE 'SupportedButRuntimeWinnerUnproven' END AS status FROM defs c LEFT JOIN agg ON cid = c.id WHERE c.k % 8 < 6 AND c.us <> '')"""

SURFACE = r"""man AS (SELECT p_partkey AS k, 'C' || CAST(p_partkey AS VARCHAR) AS cid, p_name AS en FROM part),
 ret AS (SELECT k, CASE WHEN k % 70 = 2 THEN 'Z' || CAST(k AS VARCHAR) ELSE cid END AS cid, CASE WHEN k % 40 = 3 THEN en || '!' ELSE en END AS en, k + 2 + extra AS nr, CASE WHEN k % 30 = 7 THEN 'maybe' ELSE 'Approved' END AS dec, CASE WHEN k % 5 = 0 THEN '' WHEN k % 20 = 9 THEN '{y} text' WHEN k % 2 = 0 THEN CASE WHEN k % 24 = 4 THEN 'no token' ELSE 'a {x} b' END WHEN k % 26 = 5 THEN '<LSTag>open' ELSE 'plain' END AS draft FROM man, (VALUES (0), (1000000000)) AS e(extra) WHERE k % 50 <> 0 AND (extra = 0 OR k % 60 = 1)),
 met AS (SELECT r.*, m.k AS mk, m.en AS men, row_number() OVER (PARTITION BY r.cid ORDER BY r.nr) AS nth FROM ret r LEFT JOIN man m ON m.cid = r.cid),
 found AS (SELECT 'MUL002' AS code, cid AS record, nr AS row_number FROM met WHERE nth > 1
  UNION ALL SELECT 'MUL001', cid, nr FROM met WHERE mk IS NULL UNION ALL SELECT 'MUL003', cid, nr FROM met WHERE en <> men UNION ALL SELECT 'MUL004', cid, nr FROM met WHERE mk IS NOT NULL AND dec = 'maybe'
  UNION ALL SELECT 'MUL005', cid, nr FROM met WHERE mk IS NOT NULL AND (draft IN ('{y} text', 'no token', '<LSTag>open'))
  UNION ALL SELECT 'MUL007', cid, NULL FROM man WHERE cid NOT IN (SELECT cid FROM ret))"""
MATCHES = r"""rules(rule_id, kind, pat, category, fold) AS (VALUES ('U1', 'literal', 'the', 'word', false), ('U2', 'literal', 'the ', 'word', true), ('U3', 'literal', 'ción', 'ending', false), ('U4', 'literal', '|', 'symbol', false), ('U5', 'literal', '.' || chr(10), 'symbol', false), ('U6', 'regex', '[0-9]+', 'number', false), ('U7', 'regex', '[a-z0-9]+@[a-z0-9]+', 'address', true), ('U8', 'literal', 'the', 'again', false)),
said AS (SELECT doc_id, rule_id, kind, pat, category, text, CASE WHEN fold THEN lower(text) ELSE text END AS t FROM documents, rules),
cuts AS (SELECT doc_id, rule_id, category, text, string_split(t, pat) AS parts, [pat] AS hits, true AS lit FROM said WHERE kind = 'literal' UNION ALL SELECT doc_id, rule_id, category, text, regexp_split_to_array(t, pat) AS parts, regexp_extract_all(t, pat) AS hits, false AS lit FROM said WHERE kind = 'regex'),
nth AS (SELECT *, unnest(range(1, len(parts))) AS i FROM cuts WHERE len(parts) > 1),
placed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, start + n, rule_id) AS place, CAST(start AS INTEGER) AS start, CAST(start + n AS INTEGER) AS "end", rule_id, category, substr(text, CAST(start AS BIGINT) + 1, CAST(n AS BIGINT)) AS matched_text FROM (SELECT doc_id, rule_id, category, text, list_sum(list_transform(parts[1:i], lambda x: length(x))) + CASE WHEN lit THEN (i - 1) * length(hits[1]) WHEN i = 1 THEN 0 ELSE list_sum(list_transform(hits[1:i - 1], lambda x: length(x))) END AS start, length(CASE WHEN lit THEN hits[1] ELSE hits[i] END) AS n FROM nth))"""

ORACLE: dict[str, str] = {
    "normalize_records": "SELECT doc_id, lang, sha256(text) AS text_hash, CAST(length(text) AS BIGINT) AS n_text FROM documents",
    "align_locales": "SELECT source, " + ", ".join(f"nullif(count(*) FILTER (lang = '{x}'), 0) AS n_{x}" for x in ("en", "de", "fr", "es")) + " FROM documents GROUP BY source",
    "presence_status": "SELECT p_partkey, CASE WHEN p_size % 2 = 1 AND p_size < 25 THEN 'both' WHEN p_size % 2 = 1 THEN 'source-only' ELSE 'target-only' END AS presence_status FROM part WHERE p_size % 2 = 1 OR p_size < 25",
    "round_trip": "SELECT p_partkey, p_size AS size_before, CASE WHEN p_partkey % 101 = 0 THEN NULL ELSE p_size + 1 END AS size_after FROM part WHERE p_partkey % 97 = 0 OR p_partkey % 101 = 0",
    "reuse_classes": f"WITH {REUSE} SELECT * FROM classes",
    "reuse_conflict_groups": f"WITH {REUSE}, g AS (SELECT source_text, count(*) AS n_boundary, min(p_partkey) AS first_uid FROM classes WHERE reuse_class = 'conflict' GROUP BY source_text) SELECT printf('CONFLICT-%03d', row_number() OVER (ORDER BY n_boundary DESC, source_text)) AS group_id, source_text, n_boundary, first_uid FROM g",
    "reference_flags": "SELECT c_custkey AS custkey, " + ", ".join(f"coalesce(bool_or(o_orderstatus = '{s}'), false) AS has_{s}" for s in "FOP") + " FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "neighbor_context": "WITH n AS (SELECT conv_id, turn, text, lag(text, 1, '') OVER w AS p, lead(text, 1, '') OVER w AS x FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, md5(p) AS previous_md5, md5(x) AS next_md5 FROM n WHERE text <> '' AND (p <> '' OR x <> '')",
    "overlay_winner": "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderpriority[1] AS INTEGER), o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
    "path_collision": "SELECT c_nationkey, count(*) AS n_rows, count(DISTINCT lower(c_mktsegment)) AS n_values, count(DISTINCT lower(c_mktsegment)) > 1 AS collides FROM customer GROUP BY c_nationkey",
    "first_rule_wins": "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^PROMO') THEN 'promo' WHEN regexp_matches(p_type, '(SMALL|MEDIUM|LARGE)$') THEN 'sized' WHEN regexp_matches(p_type, 'ECON|STAND') THEN 'plain' ELSE 'unmatched' END AS rule_id FROM part",
    "layer_audit": "WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_returnflag) - 1 AS r FROM lineitem), b AS (SELECT l_partkey, r, CASE WHEN r = 0 THEN 'effective' WHEN l_returnflag = 'R' THEN 'returned' WHEN r = 1 THEN 'runner-up' ELSE 'shadowed' END AS reason FROM a) SELECT l_partkey, reason, count(*) AS n, max(r) AS last_rank FROM b GROUP BY ALL",
    "layered_merge": "WITH a AS (SELECT *, CASE WHEN o_totalprice > 200000 THEN o_orderkey END AS value, row_number() OVER w AS rn, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)) SELECT o_custkey, count(*) FILTER (stops = 0) AS n_layers, arg_min(value, rn) FILTER (stops = 0 AND value IS NOT NULL) AS merged_value FROM a GROUP BY o_custkey",
    "evidence_union": "SELECT md5(text) AS text_md5, min(doc_id) AS first_id, count(*) AS n_evidence, string_agg(DISTINCT source, ' | ' ORDER BY source) AS sources FROM documents GROUP BY 1",
    "mapping_union": """WITH o AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'bark' ELSE 'quest' END AS kind, lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents) SELECT source, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars, count(*) AS n_mappings, count(*) FILTER (kind = 'context') > 0 AS "hasContext", count(*) FILTER (kind = 'bark') > 0 AS "hasBark", false AS "hasReview" FROM o GROUP BY source""",
    "role_heads": """WITH o AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'bark' ELSE 'quest' END AS kind, lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents) SELECT source, kind, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS n_evidence FROM o GROUP BY source, kind""",
    "role_evidence": """WITH o AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'bark' ELSE 'quest' END AS kind, lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents) SELECT source, kind, row_number() OVER (PARTITION BY source, kind ORDER BY doc_id) AS evidence_no, doc_id FROM o""",
    "total_order": "SELECT doc_id, source, lang, length(text) AS n_text, row_number() OVER (ORDER BY lower(lang), lower(source), length(text) DESC, doc_id) AS ordinal FROM documents",
    "priority_dedup": "SELECT text_md5, doc_id, class_rank FROM (SELECT *, row_number() OVER (PARTITION BY text_md5 ORDER BY class_rank, doc_id) AS rn FROM (SELECT doc_id, md5(text) AS text_md5, CASE quality WHEN 1 THEN 0 WHEN 0 THEN 2 ELSE 1 END AS class_rank FROM documents LEFT JOIN labels USING (doc_id))) WHERE rn = 1",
    "layered_fields": f"WITH {LAYERS}, w AS (SELECT *, row_number() OVER (PARTITION BY name, field ORDER BY rn) AS nth FROM brought) SELECT name, field, value, o_orderkey FROM w WHERE nth = 1",
    "layered_heads": f"WITH {LAYERS} SELECT l.name, n_layers, coalesce((SELECT \"using\" FROM layers x WHERE x.name = l.name AND x.rn = s.stop), '') AS \"using\", o_orderkey FROM layers l JOIN stops s ON s.name = l.name WHERE l.rn = 1",
    "inherited_fields": f"WITH RECURSIVE {FAMILY}, w AS (SELECT walk.entity, field, node AS owner, depth, value, row_number() OVER (PARTITION BY walk.entity, field ORDER BY depth) AS nth FROM walk JOIN own ON own.entity = walk.node) SELECT entity, field, owner, depth, value FROM w WHERE nth = 1",
    "inheritance_ends": f"WITH RECURSIVE {FAMILY}, last AS (SELECT entity, node, row_number() OVER (PARTITION BY entity ORDER BY depth DESC) AS nth FROM walk) SELECT l.entity, CASE WHEN e.up = '' THEN 'root' WHEN e.up LIKE 'gone-%' THEN 'missing' ELSE 'cycle' END AS ends FROM last l JOIN ent e ON e.entity = l.node WHERE nth = 1",
    "runtime_edges": f"WITH RECURSIVE {EDGES}, {RUNTIME} SELECT child_id, itself, status, n_candidates, CASE status WHEN 'ResolvedSameProviderDefinition' THEN same_id WHEN 'ResolvedUniqueCompatibleDefinition' THEN any_id WHEN 'ResolvedByDirectModuleDependency' THEN near_id WHEN 'ResolvedByTransitiveModuleDependency' THEN far_id END AS selected_id FROM runtime",
    "runtime_outcome": f"WITH RECURSIVE {EDGES}, {RUNTIME}, v AS (SELECT 'h' || CAST(CAST(substr(child_id, 2) AS BIGINT) % 300 AS VARCHAR) AS content_uid, CASE WHEN NOT itself AND status = 'AmbiguousMultipleDefinitions' THEN 'hold' WHEN itself AND status IN ('SupportedButRuntimeWinnerUnproven', 'MetadataDoesNotCoverProvider', 'AmbiguousMultiplePriorProviders') THEN 'warning' END AS verdict FROM runtime UNION ALL SELECT 'h' || CAST(n_nationkey AS VARCHAR), 'hold' FROM nation) SELECT content_uid, min(verdict) AS verdict FROM v WHERE verdict IS NOT NULL AND content_uid IN (SELECT 'h' || CAST(p_partkey % 300 AS VARCHAR) FROM part WHERE p_partkey % 3 <> 0) GROUP BY content_uid",
    "runtime_counts": f"WITH RECURSIVE {EDGES}, {RUNTIME} SELECT count(*) FILTER (NOT itself AND status = 'AmbiguousMultipleDefinitions') AS ambiguous_edge_count, count(*) FILTER (itself AND status IN ('SupportedButRuntimeWinnerUnproven', 'MetadataDoesNotCoverProvider', 'AmbiguousMultiplePriorProviders')) AS self_name_warning_edge_count, count(*) FILTER (status = 'EquivalentProviderDefinition') AS equivalent_edge_count, count(*) FILTER (status = 'ResolvedByDirectModuleDependency') AS direct_dependency_resolved_count, count(*) FILTER (status = 'ResolvedByTransitiveModuleDependency') AS transitive_dependency_resolved_count FROM runtime",
    "inheritance_closure": "WITH RECURSIVE n AS (SELECT d.doc_id, CASE WHEN d.doc_id > 0 THEN d.doc_id // 2 END AS parent, quality FROM documents d LEFT JOIN labels USING (doc_id)), up(doc_id, place, depth) AS (SELECT doc_id, doc_id, 0 FROM n UNION ALL SELECT u.doc_id, n.parent, u.depth + 1 FROM up u JOIN n ON n.doc_id = u.place WHERE n.quality IS NULL AND n.parent IS NOT NULL), last AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth DESC) AS rn FROM up) SELECT l.doc_id, l.depth, CASE WHEN n.quality IS NOT NULL THEN l.place END AS owner, n.quality FROM last l LEFT JOIN n ON n.doc_id = l.place WHERE rn = 1",
    "dependency_closure": f"WITH RECURSIVE {EDGES} SELECT start, node, depth FROM closure",
    "precedence_status": f"WITH RECURSIVE {EDGES}, c AS (SELECT s_suppkey AS child, s_nationkey AS cm, s_suppkey % 7 AS slot FROM supplier WHERE s_suppkey % 2 = 0), o AS (SELECT s_suppkey % 7 AS slot, s_nationkey AS om FROM supplier WHERE s_suppkey % 2 = 1), j AS (SELECT child, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM edges WHERE a <> b) e WHERE e.a = cm AND e.b = om) AS d, (SELECT count(*) FROM closure x WHERE x.start = cm AND x.node = om AND x.depth <= 2) AS t FROM c JOIN o USING (slot)), n AS (SELECT child, count(*) AS n_candidates, CAST(sum(d) AS BIGINT) AS n_direct, CAST(sum(t) AS BIGINT) AS n_transitive FROM j GROUP BY child) SELECT *, CASE WHEN n_direct = 1 THEN 'direct' WHEN n_direct = 0 AND n_transitive = 1 THEN 'transitive' WHEN n_direct + n_transitive > 0 THEN 'ambiguous' ELSE 'unproven' END AS status FROM n",
    "context_overlap": "WITH s AS (SELECT DISTINCT event_type AS t, user_id AS u FROM events WHERE value > 150), t AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS t), p AS (SELECT a.t AS left_set, b.t AS right_set FROM t a JOIN t b ON a.t < b.t), c AS (SELECT left_set, right_set, (SELECT count(*) FROM s WHERE s.t = left_set) AS n_left, (SELECT count(*) FROM s WHERE s.t = right_set) AS n_right, (SELECT count(*) FROM s x JOIN s y ON x.u = y.u WHERE x.t = left_set AND y.t = right_set) AS n_both FROM p) SELECT *, n_left + n_right - n_both AS n_union, n_both = 0 AS disjoint FROM c",
    "universe_partition": f"WITH {UNIVERSE} SELECT doc_id, universe_class FROM parted",
    "residual_resolution": f"WITH {UNIVERSE} SELECT doc_id, universe_class, CASE WHEN quality = 0 THEN 'rejected' WHEN copies > 1 THEN 'duplicate' WHEN lang IN ('de', 'fr') THEN 'auxiliary-confirmed' ELSE 'unresolved' END AS resolution FROM parted WHERE universe_class IN ('context-hold', 'source-unconfirmed')",
    "set_algebra": "WITH k AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey) SELECT CASE WHEN f AND o THEN 'intersect' WHEN f THEN 'left-only' ELSE 'right-only' END AS relation, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS key_sum FROM k WHERE f OR o GROUP BY 1",
    "ownership_evidence": f"WITH {HITS} SELECT category, confidence, reason, rule_id, resource_path, count(*) AS n FROM hits GROUP BY ALL",
    "functional_ownership": f"""WITH {HITS}, g AS (SELECT uid, category, min(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS c, count(*) AS n FROM hits GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY c, list_position(['bark', 'quest', 'skill_spell', 'item', 'book_lore', 'character_world', 'system_message', 'tutorial', 'ui', 'dialogue_general', 'other'], category)) AS i FROM g),
 w AS (SELECT uid, max(category) FILTER (i = 1) AS cat, max(c) FILTER (i = 1) AS c, string_agg('also:' || category, ';' ORDER BY i) FILTER (i > 1) AS tags, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY uid)
 SELECT uid, coalesce(cat, 'other') AS primary_category, coalesce(['high', 'medium', 'low'][c + 1], 'low') AS confidence, coalesce(tags, '') AS tags, CASE WHEN cat IS NULL THEN 'unclassified' ELSE 'classified' END AS status, coalesce(n, 0) AS n_evidence FROM (SELECT DISTINCT p_partkey % 700 AS uid FROM part) LEFT JOIN w USING (uid)""",
    "classify_ownership": f"WITH {CANDIDATES} SELECT * FROM owners",
    "classification_summary": f"WITH {CANDIDATES} SELECT d.primary_category, count(o.p_partkey) AS n FROM (SELECT unnest(['bark', 'quest', 'skill_spell', 'item', 'ui', 'other', 'tutorial']) AS primary_category) d LEFT JOIN owners o USING (primary_category) GROUP BY 1",
    "decision_overlay": "SELECT doc_id, CASE WHEN quality = 1 THEN 'item' WHEN quality = 0 THEN 'ui' WHEN doc_id % 7 IN (1, 2) THEN 'quest' END AS primary_category, CASE WHEN quality IS NOT NULL THEN 'classified' WHEN doc_id % 7 = 0 THEN 'excluded' WHEN doc_id % 7 < 3 THEN 'classified' ELSE 'unresolved' END AS status, CASE WHEN quality IS NOT NULL OR doc_id % 7 >= 3 THEN 'none' WHEN doc_id % 7 = 0 THEN 'exclude' ELSE 'classify' END AS action FROM documents LEFT JOIN labels USING (doc_id)",
    "group_key": "SELECT doc_id, coalesce(list_min(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'story/' || lower(source) END, CASE WHEN doc_id % 4 = 0 THEN 'lang/' || lang END], lambda x: x IS NOT NULL)), 'uid:d' || doc_id) AS group_key FROM documents",
    "batch_plan": f"WITH RECURSIVE {PLAN} SELECT * FROM plan",
    "batch_manifest": f"WITH RECURSIVE {PLAN} SELECT * FROM manifest",
    "batch_summary": f"WITH RECURSIVE {PLAN} SELECT category, count(*) AS n_batches, CAST(sum(n_records) AS BIGINT) AS n_records, min(n_records) AS least, max(n_records) AS most, round_even(avg(n_records), 4) AS mean FROM manifest GROUP BY category",
    "row_chunks": "SELECT CAST(chunk AS INTEGER) AS chunk, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 300 AS chunk FROM part) GROUP BY 1",
    "input_hash": """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","note":null,"size":' || p_size || '}') AS input_hash FROM part""",
    "seed_upsert": "WITH e AS (SELECT o_orderkey AS k, md5(o_orderpriority) AS h, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed-retryable' ELSE 'pending' END AS s, CAST(o_orderkey % 4 AS INTEGER) AS c FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 11 = 0 THEN 'changed' ELSE o_orderpriority END) AS h FROM orders WHERE o_orderkey % 5 <> 0) SELECT coalesce(e.k, n.k) AS o_orderkey, coalesce(n.h, e.h) AS input_hash, CASE WHEN e.k IS NULL THEN 'pending' WHEN n.h <> e.h THEN 'invalidated' ELSE e.s END AS status, CASE WHEN e.k IS NULL OR n.h <> e.h THEN 0 ELSE e.c END AS attempt_count, CASE WHEN e.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'untouched' WHEN n.h <> e.h THEN 'invalidate' ELSE 'keep' END AS action FROM e FULL JOIN n ON e.k = n.k",
    "attempt_numbers": f"WITH {ATTEMPTS} SELECT event_id, user_id, item, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) AS attempt_number FROM attempts",
    "state_fold": f"WITH {FOLDED} SELECT user_id, item, attempt_count, n_succeeded, last_event_id, last_outcome, status FROM folded",
    "claim_next": f"WITH {FOLDED} SELECT user_id, item, attempt_count, row_number() OVER (ORDER BY user_id, item) AS claim_order FROM folded WHERE status = 'failed-retryable' AND attempt_count < 3 ORDER BY user_id, item LIMIT 100",
    "stale_leases": f"WITH {FOLDED} SELECT user_id, item, CASE WHEN status = 'running' AND last_ts + INTERVAL 300 SECOND <= TIMESTAMP '2024-01-15' THEN 'failed-retryable' ELSE status END AS status, status = 'running' AND last_ts + INTERVAL 300 SECOND <= TIMESTAMP '2024-01-15' AS recovered FROM folded",
    "run_report": f"""WITH {ATTEMPTS}, a AS (SELECT user_id % 10 AS run_id, ts, k, outcome, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) AS nr, CASE WHEN outcome <> 'running' THEN epoch_us(ts) + k * 1000000 END AS fin,
 CASE WHEN outcome LIKE 'failed%' THEN CASE k % 5 WHEN 0 THEN 'HTTP_429' WHEN 1 THEN printf('HTTP_5%02d', k % 6) WHEN 2 THEN 'PROVIDER_TRANSPORT_ERROR' WHEN 3 THEN 'HTTP_5000' END END AS code FROM attempts),
g AS (SELECT run_id, count(*) AS n, count(*) FILTER (outcome = 'succeeded') AS s, count(*) FILTER (outcome = 'failed-retryable') AS r, count(*) FILTER (outcome = 'failed-final') AS f, count(*) FILTER (nr > 1) AS again, count(*) FILTER (code = 'HTTP_429') AS h4, count(*) FILTER (code LIKE 'HTTP@_5__' ESCAPE '@') AS h5, count(*) FILTER (code = 'PROVIDER_TRANSPORT_ERROR') AS tr, round_even(avg(k) FILTER (outcome = 'succeeded'), 4) AS m, max(fin) AS hi FROM a GROUP BY run_id),
i AS (SELECT run_id, 1500000000000000 + run_id * 3600000000 AS begun, CASE WHEN run_id % 2 = 1 THEN 1900000000000000 + run_id END AS ended FROM (SELECT unnest(range(12)) AS run_id)),
m AS (SELECT i.run_id, n, s, r, f, again, h4, h5, tr, m, hi, (coalesce(ended, hi) - begun) / 6e7 AS mins FROM i LEFT JOIN g ON g.run_id = i.run_id)
SELECT run_id, 'p' || CAST(run_id % 3 AS VARCHAR) AS provider, coalesce(n, 0) AS n_attempts, coalesce(s, 0) AS n_succeeded, coalesce(r, 0) AS n_failed_retryable, coalesce(f, 0) AS n_failed_final, coalesce(again, 0) AS n_retries, coalesce(h4, 0) AS n_http_429, coalesce(h5, 0) AS n_http_5xx, coalesce(tr, 0) AS n_transport, m AS mean_seconds, hi AS last_micros, CASE WHEN mins > 0 THEN round_even(coalesce(s, 0) / mins, 4) END AS per_minute FROM m""",
    "retry_delays": f"WITH {ATTEMPTS}, a AS (SELECT event_id, user_id AS worker_id, outcome <> 'succeeded' AS again, CASE WHEN event_id % 11 = 0 THEN k % 90 END AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM attempts), e AS (SELECT *, coalesce(max(CASE WHEN NOT again THEN n END) OVER (PARTITION BY worker_id ORDER BY n), 0) AS ended FROM a), s AS (SELECT event_id, worker_id, asked, CASE WHEN again THEN n - ended ELSE 0 END AS streak FROM e) SELECT event_id, worker_id, CAST(streak AS BIGINT) AS streak, CASE WHEN streak = 0 THEN 0.0::DOUBLE WHEN asked IS NOT NULL THEN least(asked::DOUBLE, 40.0::DOUBLE) ELSE least(40.0::DOUBLE, 1.5::DOUBLE * pow(2.0::DOUBLE, (streak - 1)::DOUBLE)) END AS delay FROM s",
    "attempt_rates": f"WITH {ATTEMPTS}, e AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'succeeded') AS s, count(*) FILTER (outcome = 'failed-final') AS f, count(*) FILTER (outcome = 'failed-retryable') AS r FROM attempts WHERE outcome <> 'running') SELECT n AS n_ended, {_percent('s', 'n')} AS success_percent, {_percent('f', 'n')} AS failure_percent, {_percent('r', 'n')} AS retry_percent FROM e",
    "error_histogram": f"WITH {ATTEMPTS}, a AS (SELECT CASE WHEN outcome LIKE 'failed%' THEN CASE k % 5 WHEN 0 THEN 'HTTP_429' WHEN 1 THEN printf('HTTP_5%02d', k % 6) WHEN 2 THEN 'PROVIDER_TRANSPORT_ERROR' WHEN 3 THEN 'HTTP_5000' END END AS error_code FROM attempts), g AS (SELECT error_code, count(*) AS n FROM a WHERE error_code IS NOT NULL GROUP BY error_code) SELECT error_code, n, row_number() OVER (ORDER BY n DESC, error_code) AS rank FROM g",
    "error_breakdown": f"WITH {ATTEMPTS}, e AS (SELECT printf('HTTP_%03d', k % 6 + 500) AS error_code FROM attempts WHERE outcome IN ('failed-final', 'failed-retryable')) SELECT error_code, count(*) AS n, count(*) FILTER (regexp_matches(error_code, '^HTTP_50[0-3]$')) AS n_server FROM e GROUP BY 1",
    "attempts_completed": """SELECT CAST(k AS VARCHAR) AS content_uid, CASE WHEN NOT running THEN 'pending' WHEN NOT ended THEN 'running' WHEN ok THEN 'succeeded' WHEN k % 4 = 0 AND k % 4 < 3 THEN 'failed-retryable' ELSE 'failed-final' END AS status, CAST(k % 4 AS INTEGER) AS attempt_count,
 CASE WHEN running AND NOT ended THEN 'w' || CAST(k % 5 AS VARCHAR) END AS lease_owner, CASE WHEN ended AND ok THEN md5(CAST(k AS VARCHAR)) END AS output_hash, CASE WHEN ended AND ok THEN 'r1' END AS last_successful_run_id,
 CASE WHEN NOT running THEN NULL WHEN NOT ended THEN 'running' WHEN ok THEN 'succeeded' WHEN k % 4 = 0 THEN 'failed-retryable' ELSE 'failed-final' END AS outcome, CASE WHEN ended AND NOT ok THEN 'E1' END AS error_code, CASE WHEN ended THEN k % 100 + k % 10 ELSE -1 END AS total_tokens, CASE WHEN ended THEN 1700000000::BIGINT ELSE -1 END AS finished
 FROM (SELECT o_orderkey AS k, o_orderkey % 3 > 0 AS running, o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 AS ended, o_orderkey % 5 > 1 AS ok FROM orders)""",
    "leases_expired": """SELECT CAST(k AS VARCHAR) AS content_uid, CASE WHEN NOT running THEN 'pending' WHEN late THEN 'failed-retryable' ELSE 'running' END AS status, CAST(k % 4 AS INTEGER) AS attempt_count, CASE WHEN running AND NOT late THEN 'w' || CAST(k % 5 AS VARCHAR) END AS lease_owner,
 CAST(NULL AS VARCHAR) AS output_hash, CAST(NULL AS VARCHAR) AS last_successful_run_id, CASE WHEN late THEN 'abandoned' WHEN running THEN 'running' END AS outcome, CASE WHEN late THEN 'LEASE_EXPIRED' END AS error_code, -1::BIGINT AS total_tokens, CASE WHEN late THEN 1700000000::BIGINT ELSE -1 END AS finished
 FROM (SELECT o_orderkey AS k, o_orderkey % 3 > 0 AS running, o_orderkey % 3 > 0 AND o_orderkey % 7 - 3 <= 0 AS late FROM orders)""",
    "rows_claimed": """SELECT CAST(o_orderkey AS VARCHAR) AS content_uid, 'running' AS status, CAST(o_orderkey % 4 + 1 AS INTEGER) AS attempt_count, 'w9' AS lease_owner, CAST(NULL AS VARCHAR) AS output_hash, CAST(NULL AS VARCHAR) AS last_successful_run_id, 'running' AS outcome, CAST(NULL AS VARCHAR) AS error_code, -1::BIGINT AS total_tokens, -1::BIGINT AS finished
 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 < 3 ORDER BY 'b' || CAST(o_orderkey % 40 AS VARCHAR), CAST(o_orderkey AS VARCHAR) LIMIT 25""",
    "usage_cost": f"WITH {SPENT} SELECT provider, model, n_ended, n_known, n_ended - n_known AS n_unknown, prompt_tokens, completion_tokens, total_tokens, n_priced, {MONEY.format('i')} AS input_cost, {MONEY.format('o')} AS output_cost FROM spent",
    "cost_summary": f"WITH {SPENT}, s AS (SELECT CAST(sum(n_ended) AS BIGINT) AS n, CAST(sum(n_priced) AS BIGINT) AS p, sum(i) AS i, sum(o) AS o FROM spent) SELECT n AS n_ended, p AS n_priced, n - p AS n_unpriced, {MONEY.format('i')} AS input_cost, {MONEY.format('o')} AS output_cost, CASE WHEN n > 0 AND p = 0 THEN 'unavailable' WHEN n = p THEN 'complete' ELSE 'partial' END AS cost_status FROM s",
    "attempt_summary": f"WITH {METERED}, s AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'succeeded') AS ok, count(*) FILTER (attempt_number > 1) AS r, count(*) FILTER (outcome = 'failed-final') AS f FROM metered) SELECT n AS n_attempts, ok AS n_succeeded, r AS n_retries, round_even(100.0::DOUBLE * r / n, 2) AS retry_percent, f AS n_failed_final, round_even(100.0::DOUBLE * f / n, 2) AS failed_final_percent, round_even(n::DOUBLE / ok, 4) AS attempts_per_success FROM s",
    "token_forecast": f"""WITH {METERED}, c AS (SELECT *, CASE WHEN user_id % 50 = 0 THEN 'rare-' || CAST(user_id AS VARCHAR) ELSE model END AS category FROM metered),
 own AS (SELECT category, count(*) AS n, sum(p) AS p, sum(q) AS q FROM c WHERE outcome = 'succeeded' AND p IS NOT NULL AND q IS NOT NULL GROUP BY 1), g AS (SELECT coalesce(sum(n), 0) AS n, sum(p) AS p, sum(q) AS q FROM own),
 l AS (SELECT category, count(*) AS r FROM c WHERE outcome = 'failed-retryable' GROUP BY 1)
 SELECT CASE WHEN max(g.n) >= 10 THEN 'available' ELSE 'unavailable' END AS status, CAST(sum(r) AS BIGINT) AS n_remaining, CAST(max(g.n) AS BIGINT) AS n_samples,
 CAST(round(sum(r * CASE WHEN own.n >= 10 THEN own.p::DOUBLE / own.n ELSE g.p::DOUBLE / g.n END)) AS BIGINT) AS prompt_tokens, CAST(round(sum(r * CASE WHEN own.n >= 10 THEN own.q::DOUBLE / own.n ELSE g.q::DOUBLE / g.n END)) AS BIGINT) AS completion_tokens FROM l LEFT JOIN own USING (category), g""",
    "accounting_order": f"WITH {COMPLETION}, g AS (SELECT category, count(*) FILTER (status <> 'succeeded') AS n_remaining FROM st GROUP BY category) SELECT row_number() OVER (ORDER BY n_remaining DESC, category) AS rank, category, n_remaining FROM g",
    "accounting_categories": f"""WITH {COMPLETION}, z AS (SELECT v.category, status, CASE WHEN r.route IS NOT NULL AND r.output_hash = v.output_hash AND r.ruleset = 'v2' THEN r.route END AS route, disposition FROM st v JOIN completion c ON c.conv_id = v.conv_id AND c.turn = v.turn LEFT JOIN (SELECT * FROM results WHERE conv_id % 23 <> 6) r ON r.conv_id = v.conv_id AND r.turn = v.turn)
 SELECT category, count(*) AS n_total, count(*) FILTER (status = 'succeeded') AS n_succeeded, count(*) FILTER (status <> 'succeeded') AS n_remaining, count(*) FILTER (disposition = 'WAITING_RETRY') AS n_retry, count(*) FILTER (status = 'failed-final') AS n_failed_final,
 count(*) FILTER (route = 'PASS') AS n_qa_pass, count(*) FILTER (route = 'REVIEW') AS n_qa_review, count(*) FILTER (disposition = 'MERGE_READY') AS n_merge_ready, round_even(100.0::DOUBLE * count(*) FILTER (status = 'succeeded') / count(*), 2) AS succeeded_percent, round_even(100.0::DOUBLE * count(*) FILTER (disposition = 'MERGE_READY') / count(*), 2) AS merge_ready_percent FROM z GROUP BY category""",
    "remaining_estimate": f"WITH {ATTEMPTS}, a AS (SELECT *, CASE WHEN user_id % 50 = 0 THEN 'rare-' || user_id ELSE event_type END AS category FROM attempts), s AS (SELECT category, count(k) AS n, avg(k) AS m FROM a WHERE outcome = 'succeeded' GROUP BY 1), w AS (SELECT avg(k) AS m FROM a WHERE outcome = 'succeeded'), r AS (SELECT category, count(*) AS n_remaining FROM a WHERE outcome <> 'succeeded' GROUP BY 1) SELECT category, n_remaining, coalesce(n, 0) AS n_samples, CASE WHEN n >= 10 THEN 'category' ELSE 'global' END AS basis, CAST(round_even(CASE WHEN n >= 10 THEN s.m ELSE w.m END * n_remaining, 0) AS BIGINT) AS estimate FROM r LEFT JOIN s USING (category), w",
    "domain_summary": "SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source",
    "resource_audit": f"SELECT lang, count(*) AS n_docs, count(quality) AS n_labelled, {_percent('count(quality)', 'count(*)')} AS labelled_percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "qa_route": f"WITH {QA} SELECT conv_id, turn, category, route, array_to_string(issues, ';') AS issues FROM judged",
    "qa_issues": f"WITH {QA} SELECT category, issue_code, count(*) AS n FROM (SELECT category, unnest(issues) AS issue_code FROM judged) GROUP BY ALL",
    "qa_stale": f"WITH {QA} SELECT * FROM staleness",
    "qa_coverage": f"WITH {QA} SELECT route, CASE WHEN is_stale THEN 'stale' ELSE 'checked' END AS checked, count(*) AS n FROM staleness GROUP BY ALL UNION ALL SELECT NULL, 'not checked', (SELECT count(*) FROM conversations) - (SELECT count(*) FROM staleness)",
    "qa_counts": f"WITH {QA} SELECT route, count(*) AS n, count(*) FILTER (NOT is_stale) AS n_checked, count(*) FILTER (is_stale) AS n_stale FROM staleness GROUP BY route",
    "protected_tokens": f"SELECT page_id, len({TOKENS}) AS n_tokens, array_to_string({TOKENS}, ',') AS tokens FROM pages",
    "token_multiset_diff": f"WITH t AS (SELECT page_id, {TOKENS} AS x FROM pages), j AS (SELECT p.page_id, p.x AS a, q.x AS b FROM t p JOIN t q ON q.page_id = p.page_id + 1) SELECT page_id, {MINUS.format(a='a', b='b')} AS missing, {MINUS.format(a='b', b='a')} AS unexpected FROM j",
    "markup_check": r"WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '(</?p(?:\s[^>]*)?>)', 1), lambda x: CASE WHEN starts_with(x, '</') THEN -1 ELSE 1 END) AS d FROM pages) SELECT page_id, CAST(coalesce(list_sum(d), 0) AS BIGINT) AS depth, coalesce(list_sum(d), 0) = 0 AND coalesce(list_min(list_transform(range(1, len(d) + 1), lambda i: list_sum(d[1:i]))), 0) >= 0 AS is_balanced FROM t",
    "usage_matches": f"WITH {MATCHES} SELECT doc_id, place, start, \"end\", rule_id, category, matched_text FROM placed",
    "usage_match_counts": f"WITH {MATCHES} SELECT 'rule' AS level, rule_id AS name, count(*) AS n FROM placed GROUP BY rule_id UNION ALL SELECT 'category' AS level, category AS name, count(*) AS n FROM placed GROUP BY category",
    "usage_candidates": f"WITH {MATCHES}, g AS (SELECT doc_id, count(*) AS n, string_agg(concat_ws(':', start, \"end\", rule_id), ',' ORDER BY place) AS said FROM placed WHERE doc_id % 3 <> 0 GROUP BY doc_id) SELECT 'TWUSAGE-' || upper(substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16)) AS candidate_id, doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END) AS source_md5, md5(text) AS target_md5, n AS finding_count, md5(said) AS findings_md5 FROM g JOIN documents USING (doc_id)",
    "surface_findings": f"WITH {SURFACE} SELECT code, record, CAST(row_number AS BIGINT) AS row_number FROM found",
    "surface_statuses": f"WITH {SURFACE} SELECT cid AS \"CandidateId\", CAST(nr AS BIGINT) AS row_number, CASE WHEN nr IN (SELECT row_number FROM found WHERE row_number IS NOT NULL) THEN 'Failed' ELSE 'Passed' END AS validation_status FROM ret",
    "usage_rules": "SELECT doc_id, rule_id, n_matches FROM (SELECT doc_id, rule_id, CAST((length(text) - length(replace(text, lit, ''))) / length(lit) AS BIGINT) AS n_matches FROM documents, (VALUES ('U1', 'the'), ('U2', 'ción'), ('U3', 'und'), ('U4', 'les ')) r(rule_id, lit)) WHERE n_matches > 0",
    "handle_scan": "SELECT page_id, len(h) AS n_handles, len(list_distinct(h)) AS n_distinct FROM (SELECT page_id, regexp_extract_all(html, '([A-Za-z]+[0-9]+)', 1) AS h FROM pages)",
    "merge_ready": f"WITH {COMPLETION} SELECT * FROM completion WHERE disposition = 'MERGE_READY'",
    "unresolved": f"WITH {COMPLETION} SELECT * FROM completion WHERE disposition <> 'MERGE_READY'",
    "completion_view": f"WITH {COMPLETION} SELECT * FROM completion",
    "completion_rollup": f"WITH {COMPLETION} SELECT 'ALL' AS category, disposition, count(*) AS n FROM completion GROUP BY disposition UNION ALL SELECT category, disposition, count(*) FROM completion GROUP BY category, disposition",
    "merge_bridge": "SELECT o_orderkey, o_custkey, coalesce(t.c_mktsegment, s.c_mktsegment) AS version, CASE WHEN t.c_custkey IS NOT NULL THEN 'target' WHEN s.c_custkey IS NOT NULL THEN 'source' ELSE 'missing' END AS version_from FROM orders LEFT JOIN customer t ON t.c_custkey = o_custkey AND t.c_custkey % 3 = 0 LEFT JOIN customer s ON s.c_custkey = o_custkey AND s.c_custkey % 7 <> 0 WHERE o_orderstatus = 'F'",
    "merge_records": f"WITH {EDITS} SELECT p_partkey, p_name, action FROM merged",
    "merge_checks": f"WITH {EDITS}, k AS (SELECT *, p_partkey % 50 = 13 AS gone FROM merged) SELECT count(*) FILTER (gone AND old IS NOT NULL) AS n_lost, count(*) FILTER (gone AND new IS NOT NULL) AS n_edit_missing, count(*) FILTER (gone AND new IS NULL) AS n_foreign_change, count(*) FILTER (new IS NOT NULL AND new IS DISTINCT FROM old) AS n_changed, count(*) AS n_rows FROM k",
    "snapshot_digest": "SELECT count(*) AS n_rows, sha256(string_agg(n_nationkey || chr(9) || n_name, chr(10) ORDER BY n_nationkey)) AS snapshot_sha256 FROM nation",
    "review_candidates": "SELECT md5(text) AS text_md5, array_to_string(list_sort(list_distinct(list('DOC-' || upper(sha256(lower(source || ':' || lang))[1:16])))), ';') AS candidates FROM documents GROUP BY 1",
    "row_validation": "WITH b AS (SELECT CASE WHEN p_partkey % 89 = 0 THEN -p_partkey ELSE p_partkey END AS k, CASE WHEN p_partkey % 31 = 0 AND p_partkey % 89 <> 0 OR (p_partkey % 89 = 0 AND p_partkey % 31 = 0) THEN '' ELSE p_name END AS name, p_size FROM part UNION ALL SELECT p_partkey, p_name, 0 FROM part WHERE p_partkey % 71 = 0), r AS (SELECT b.*, p.p_size AS base, p.p_partkey IS NOT NULL AS known, row_number() OVER (PARTITION BY k ORDER BY b.p_size DESC, name) > 1 AS again FROM b LEFT JOIN part p ON p.p_partkey = k) SELECT k AS p_partkey, 'VAL001' AS code, 'error' AS severity FROM r WHERE NOT known UNION ALL SELECT k, 'VAL002', 'error' FROM r WHERE again UNION ALL SELECT k, 'VAL003', 'error' FROM r WHERE known AND p_size <> base UNION ALL SELECT k, 'VAL102', 'warning' FROM r WHERE name = ''",
    "immutable_diff": "SELECT p_partkey, 'p_name' AS column_name, p_name AS expected, upper(p_name) AS returned FROM part WHERE p_partkey % 37 = 0 AND upper(p_name) <> p_name",
    "reconcile_reviews": "WITH r AS (SELECT user_id * 100 + event_id % 100 AS uid, event_type = 'click' AS revise, CASE WHEN event_id % 9 > 0 THEN 'p' || event_id % 2 END AS proposal FROM events WHERE event_type IN ('click', 'view', 'error')), g AS (SELECT uid, count(*) AS n_reviews, count(*) FILTER (revise AND proposal IS NULL) AS blank, count(DISTINCT CASE WHEN revise THEN proposal END) AS n_proposals, min(CASE WHEN revise THEN proposal END) AS one FROM r GROUP BY uid), x AS (SELECT *, CASE WHEN blank > 0 OR n_proposals > 1 THEN 'conflict' WHEN n_proposals = 1 THEN 'adopted' ELSE 'unchanged' END AS resolution FROM g) SELECT uid, n_reviews, n_proposals, resolution, CASE WHEN resolution = 'adopted' THEN one END AS resolved_text FROM x",
    "attempt_stream": "SELECT epoch_us(date_trunc('day', ts)) AS window_micros, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "batch_inputs": f"WITH {BATCH_SOURCES} SELECT uid AS content_uid, category AS primary_category, array_to_string(c, ';') AS candidates, array_to_string(s, ';') AS subkeys, group_key FROM grouped",
    "batch_order": f"WITH {BATCH_SOURCES} SELECT uid AS content_uid, group_key, row_number() OVER (PARTITION BY group_key ORDER BY s, lower(uid)) AS place FROM grouped",
    "provider_discovery": f"""WITH {ENTRIES}, t AS (SELECT *, CASE f WHEN 0 THEN ['SpellData'] WHEN 1 THEN ['PassiveData'] WHEN 2 THEN ['StatusData'] WHEN 3 THEN ['Tutorial definitions', 'UI/GUI definitions'] WHEN 4 THEN ['Root Templates'] WHEN 5 THEN ['System message definitions'] WHEN 6 THEN ['UI/GUI definitions'] ELSE ['FeatDescriptions'] END AS n,
 CASE f WHEN 0 THEN ['Spell'] WHEN 1 THEN ['Passive'] WHEN 2 THEN ['Status'] WHEN 3 THEN ['Tutorial', 'Xaml'] WHEN 4 THEN ['RootTemplate'] WHEN 5 THEN ['SystemMessage'] WHEN 6 THEN ['Xaml'] ELSE ['Feat'] END AS sub,
 CASE f WHEN 0 THEN ['Ability.Cantrip', 'Ability.ClassAction', 'Ability.Spell', 'Ability.WeaponAction'] WHEN 1 THEN ['Ability.ClassFeature', 'Ability.Passive'] WHEN 2 THEN ['Ability.Condition', 'Ability.Status'] WHEN 3 THEN ['UI.Tutorial', 'UI.Unknown'] WHEN 4 THEN ['Ability.Unknown', 'Item.Unknown', 'UI.Tooltip'] WHEN 5 THEN ['UI.ErrorMessage', 'UI.SystemPrompt'] WHEN 6 THEN ['UI.Unknown'] ELSE ['Ability.Feat', 'UI.LevelUp'] END AS dom
 FROM entries WHERE package <> 'Other.pak' AND f < 8)
 SELECT package, internal_path, CASE WHEN f IN (0, 1, 2) THEN 'StatsTXT' WHEN f = 5 THEN 'OtherTXT' WHEN f = 4 THEN 'LSF' WHEN f = 7 THEN 'LSX' ELSE 'XAML' END AS resource_format, m AS module,
 array_to_string(list_sort(list_concat(n, list_filter([CASE WHEN m IN ('Shared', 'SharedDev', 'Gustav') THEN m || ' module projection' END, CASE WHEN f IN (3, 6) THEN 'Engine/Game UI projection' END], lambda x: x IS NOT NULL))), ';') AS families, array_to_string(sub, ';') AS subfamilies, array_to_string(dom, ';') AS domains,
 CASE WHEN package = 'Shared.pak' AND f = 2 AND m IN ('Shared', 'SharedDev') THEN 'ContextEvidenceAndCollisionProvenance' WHEN package = 'Shared.pak' AND f IN (0, 1, 2, 5) OR package = 'GustavX.pak' AND f IN (0, 1, 2) OR package = 'Gustav.pak' AND (f = 1 OR f = 0 AND m = 'Honour') THEN 'ContextEvidenceOnly' ELSE 'CandidateEvidence' END AS role,
 count(*) OVER (PARTITION BY internal_path) > 1 AS collision FROM t""",
    "path_domains": f"WITH {ENTRIES} SELECT package, internal_path, CASE WHEN regexp_matches(lower(internal_path), 'ability|spell|status|passive') THEN 'AbilityOrSkill' WHEN regexp_matches(lower(internal_path), 'item|armor|weapon') THEN 'ItemsAndEquipment' WHEN regexp_matches(lower(internal_path), 'tutorial|system') THEN 'TutorialAndSystem' WHEN regexp_matches(lower(internal_path), 'ui|hud|tooltip') THEN 'UserInterface' ELSE 'GenericUiSkill' END AS domain FROM entries",
    "universe_workstreams": """WITH o AS (SELECT l_orderkey AS k, l_linenumber % 6 AS f, l_orderkey % 4 = 0 OR l_returnflag = 'R' AS c FROM lineitem), a AS (SELECT k, count(*) AS n_rows, bool_or(NOT c) AS spoken, list(f) FILTER (NOT c) AS x, list(f) AS y FROM o GROUP BY k), b AS (SELECT *, CASE WHEN spoken THEN x ELSE y END AS fs FROM a)
 SELECT k AS content_uid, CASE WHEN o_orderstatus = 'P' THEN 'Hold' ELSE 'Eligible' END AS status, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'AQResourceReferencedReview' WHEN list_has_any(fs, [0, 4]) THEN 'AbilitySkill' WHEN list_contains(fs, 1) THEN 'ItemsEquipment' WHEN list_contains(fs, 2) THEN 'TutorialSystem' WHEN list_contains(fs, 3) THEN 'UserInterface' ELSE 'OtherMultiDomain' END AS workstream, n_rows FROM b LEFT JOIN orders ON o_orderkey = k""",
    "layer_holds": "WITH o AS (SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS path, l_returnflag AS pkg, l_suppkey % 3 AS uid FROM lineitem WHERE l_linenumber = 1 AND l_returnflag IN ('A', 'R')), both_ AS (SELECT path FROM o GROUP BY path HAVING count(DISTINCT pkg) = 2) SELECT path, uid FROM o JOIN both_ USING (path) GROUP BY path, uid HAVING count(*) = 1",
    "accepted_coverage": "SELECT c_custkey, 'accepted' AS kind FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING' OR c_custkey % 50 = 0 UNION ALL SELECT c_custkey, 'cross-domain' FROM customer WHERE c_acctbal < 5000 AND c_nationkey < 12 AND c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'referenced' FROM customer WHERE c_acctbal > 0 AND c_nationkey > 20",
    "lineage_uids": f"""WITH RECURSIVE {DEFINITIONS}, one AS (SELECT c.id, min(p.id) AS parent FROM d c JOIN d p ON p.provider = c.provider AND p.name = c.up AND p.id <> c.id AND (c.t = '' OR p.t = '' OR c.t = p.t) GROUP BY c.id HAVING count(*) = 1),
 e AS (SELECT d.id, parent, d.name = d.up OR parent IS NULL AS open FROM d LEFT JOIN one USING (id) WHERE up IS NOT NULL),
 o AS (SELECT DISTINCT split_part(f, ' ', 1) AS uid, provider, name FROM d), m AS (SELECT uid, o.provider, o.name, count(*) AS n, count(*) FILTER (list_contains(string_split(f, ' '), uid)) AS h, min(id) AS lone, min(id) FILTER (list_contains(string_split(f, ' '), uid)) AS exact FROM o JOIN d ON d.provider = o.provider AND d.name = o.name GROUP BY ALL),
 w AS (SELECT DISTINCT uid, CASE WHEN n = 1 THEN lone ELSE exact END AS id FROM m WHERE n = 1 OR h = 1 UNION SELECT w.uid, e.parent FROM w JOIN e ON e.id = w.id WHERE e.parent IS NOT NULL) SELECT w.id AS edge_id, uid AS content_uid FROM w JOIN e ON e.id = w.id WHERE open""",
    "equivalent_definitions": "SELECT s_suppkey % 40 AS name, count(*) AS n_definitions, count(DISTINCT (CASE WHEN s_nationkey % 5 > 1 THEN 'up' ELSE '' END) || '|' || s_suppkey % 80) AS n_signatures, n_signatures <= 1 AS is_equivalent FROM supplier GROUP BY 1",
    "inventory_digest": """WITH c AS (SELECT s_name, [s_name, CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR)] AS v FROM supplier), h AS (SELECT s_name, list_aggregate(list_transform(v, lambda x: printf('%016x', octet_length(encode(x))) || hex(encode(x))), 'string_agg', '') AS x FROM c), n AS (SELECT count(*) AS n_rows, CAST(count(*) AS VARCHAR) AS t, string_agg(x, '' ORDER BY s_name) AS x FROM h)
 SELECT n_rows, sha256(unhex(coalesce(x, '') || printf('%016x', octet_length(encode(t))) || hex(encode(t)))) AS inventory_sha256 FROM n""",
    "return_validation": f"WITH {RETURNED} SELECT ContentUid, part_no, array_to_string(e, ';') AS errors, warnings, len(e) = 0 AND takes AS accepted FROM checked",
    "return_summary": f"""WITH {RETURNED}, z AS (SELECT count(*) AS n_returned, (SELECT count(*) FROM base) AS n_baseline, count(*) FILTER (len(e) = 0 AND takes) AS n_accepted, count(*) FILTER (len(e) > 0) AS n_rejected, CAST(sum(len(e)) AS BIGINT) AS n_errors, count(*) FILTER (warnings <> '') AS n_warnings, (SELECT count(*) FROM base) - count(DISTINCT ContentUid) FILTER (NOT list_contains(e, 'VAL001')) AS n_missing,
 bool_or(list_has_any(e, ['VAL001', 'VAL002'])) AS a, bool_or(list_has_any(e, ['VAL003', 'VAL004', 'VAL005', 'VAL011'])) AS b, bool_or(list_has_any(e, ['VAL006', 'VAL007', 'VAL008'])) AS c FROM checked)
 SELECT n_returned, n_baseline, n_accepted, n_rejected, n_errors, n_warnings, n_missing, CAST(NULL AS DOUBLE) AS coverage, CASE WHEN n_errors = 0 THEN 'pass' WHEN n_accepted = 0 THEN 'fail' ELSE 'partial' END AS status, CASE WHEN n_errors = 0 THEN 0 WHEN a THEN 33 WHEN b THEN 34 WHEN c THEN 35 ELSE 36 END AS exit_code, CASE WHEN n_errors = 0 THEN '' WHEN a THEN 'IDENTITY_VALIDATION_FAILED' WHEN b THEN 'IMMUTABLE_FIELD_VALIDATION_FAILED' WHEN c THEN 'PROTECTED_TOKEN_VALIDATION_FAILED' ELSE 'COVERAGE_VALIDATION_FAILED' END AS exit_key FROM z""",
    "qa_due": f"WITH {QA}, {JUDGED_STATES} SELECT s9.uid AS content_uid, category FROM s9 LEFT JOIN r9 ON r9.uid = s9.uid AND r9.ruleset = 'v2' AND r9.output_hash = s9.output_hash WHERE status = 'succeeded' AND r9.uid IS NULL",
    "qa_recorded": f"WITH {QA}, {JUDGED_STATES}, x AS (SELECT coalesce(output <> '' AND conv_id % 3 = 0, false) AS again, r9.* FROM s9 JOIN r9 USING (uid)) SELECT CASE WHEN again THEN 'RETRY' ELSE route END AS route, CASE WHEN again THEN 'v2' ELSE ruleset END AS qa_rule_set_version, CASE WHEN again THEN 'new' ELSE 'in' END AS qa_input_hash, count(*) AS n, count(*) FILTER (again) AS n_issues FROM x GROUP BY ALL",
    "qa_sent_back": f"WITH {QA}, {JUDGED_STATES}, x AS (SELECT s9.*, coalesce(status = 'succeeded' AND r9.output_hash = s9.output_hash AND route = 'RETRY', false) AS back FROM s9 JOIN r9 USING (uid)) SELECT uid AS content_uid, CASE WHEN back AND tries < 3 THEN 'failed-retryable' WHEN back THEN 'failed-final' ELSE status END AS status, CASE WHEN NOT back THEN output_hash END AS output_hash, CASE WHEN back THEN output_hash END AS archived_hash FROM x",
}
