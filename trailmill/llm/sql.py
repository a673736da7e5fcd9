"""The same results in SQL."""

from __future__ import annotations

from ..sql import BLANK, VALID

RUNS = f"""WITH {VALID},
names AS (SELECT id, min(lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g'))) AS plain FROM sky_action WHERE name IS NOT NULL GROUP BY id),
same AS (SELECT id, min(id) OVER (PARTITION BY plain) AS same FROM names),
acts AS (SELECT v.*, coalesce(s.same, v.action_id) AS action FROM valid v LEFT JOIN same s ON s.id = v.action_id WHERE v.action_id > 0),
marked AS (
  SELECT *, CASE WHEN action = lag(action) OVER w AND ts - lag(ts) OVER w <= 600000000 THEN 0 ELSE 1 END AS begins
  FROM acts WINDOW w AS (PARTITION BY object_id ORDER BY ts, seq DESC NULLS LAST, event_id)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY object_id ORDER BY ts, seq DESC NULLS LAST, event_id ROWS UNBOUNDED PRECEDING) AS no FROM marked),
runs AS (
  SELECT object_id, min(action) AS action_id, first(event_id ORDER BY ts, seq DESC NULLS LAST, event_id) AS first_event_id, last(event_id ORDER BY ts, seq DESC NULLS LAST, event_id) AS last_event_id,
    min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events, max(ts) - min(ts) AS duration_us
  FROM numbered GROUP BY object_id, no)"""

TRIPLES = f"""WITH {VALID},
acts AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ts, seq DESC NULLS LAST, event_id) AS pos FROM valid WHERE action_id > 0),
least AS (SELECT greatest(3, ceil(count(DISTINCT object_id) / 60.0)) AS n FROM acts),
items AS (SELECT action_id FROM acts GROUP BY action_id HAVING count(DISTINCT object_id) >= (SELECT n FROM least)),
kept AS MATERIALIZED (SELECT * FROM acts SEMI JOIN items USING (action_id)),
pairs AS MATERIALIZED (
  SELECT DISTINCT x.object_id, x.action_id AS a, y.action_id AS b, y.pos, y.ts
  FROM kept x JOIN kept y ON x.object_id = y.object_id AND y.pos > x.pos AND y.ts - x.ts <= 1800000000),
often AS (SELECT a, b FROM pairs GROUP BY a, b HAVING count(DISTINCT object_id) >= (SELECT n FROM least)),
held AS (SELECT p.* FROM pairs p JOIN often o ON p.a = o.a AND p.b = o.b),
triples AS (
  SELECT DISTINCT x.object_id, x.a, x.b, y.action_id AS c
  FROM held x JOIN kept y ON x.object_id = y.object_id AND y.pos > x.pos AND y.ts - x.ts <= 1800000000)"""

#: Steps up to which patterns are followed in SQL; longer ones would be missed.
STEPS = 14


def _closed() -> str:
    """Frequent patterns level by level; closed are those without a longer one of the same support around them."""
    parts = [TRIPLES[: TRIPLES.index("pairs AS")] + "l1 AS (SELECT object_id, action_id::VARCHAR AS p, pos, ts FROM kept)"]
    for k in range(1, STEPS + 1):
        parts.append(f"f{k} AS MATERIALIZED (SELECT p, {k} AS steps, count(DISTINCT object_id) AS support FROM l{k} GROUP BY p HAVING count(DISTINCT object_id) >= (SELECT n FROM least))")
        parts.append(f"""l{k + 1} AS MATERIALIZED (
  SELECT DISTINCT x.object_id, x.p || ' ' || y.action_id AS p, y.pos, y.ts
  FROM (SELECT * FROM l{k} SEMI JOIN f{k} USING (p)) x JOIN kept y ON x.object_id = y.object_id AND y.pos > x.pos AND y.ts - x.ts <= 1800000000)""")
    parts.append("often AS (" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, STEPS + 1)) + ")")
    parts.append("""inner_parts AS (
  SELECT unnest([regexp_replace(p, ' [0-9]+$', ''), regexp_replace(p, '^[0-9]+ ', '')]) AS p, support FROM often WHERE steps > 1)""")
    return ",\n".join(parts) + "\nSELECT p AS actions, steps, support FROM often o ANTI JOIN inner_parts i ON i.p = o.p AND i.support = o.support"


MIXTURE = """WITH named AS (SELECT source, greatest(0, coalesce(sum(target_share), 0)) AS w, greatest(0, coalesce(max(max_repeats), 0)) AS r FROM mix_target WHERE source IS NOT NULL GROUP BY source),
goals AS (SELECT source, w / sum(w) OVER () AS share, r FROM named),
sized AS (
  SELECT d.source, doc_id, length(text) AS tokens, ('0x' || substr(md5('0 ' || doc_id), 1, 15))::BIGINT AS h
  FROM documents d JOIN goals g ON g.source = d.source WHERE doc_id IS NOT NULL AND length(text) > 0),
placed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY h, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, (sum(tokens) OVER (PARTITION BY source))::BIGINT AS every
  FROM sized),
stock AS (SELECT g.*, coalesce(every, 0) AS every FROM goals g LEFT JOIN (SELECT source, sum(tokens)::BIGINT AS every FROM sized GROUP BY source) s ON s.source = g.source),
largest AS (SELECT coalesce(min(r * every / share), 0) AS total FROM stock WHERE r * every * share > 0),
leaning AS (SELECT sum(share * r) AS mean FROM goals),
plan AS (
  SELECT source, share, r, every, least(share * (SELECT total FROM largest), (r * every)::DOUBLE) AS demand,
    0.5 * (r - (SELECT mean FROM leaning)) / (SELECT coalesce(nullif(max(abs(r - (SELECT mean FROM leaning))), 0), 1) FROM goals) AS slope
  FROM stock),
copies AS (
  SELECT p.source, p.doc_id, p.tokens, unnest(generate_series(0, ceil((demand - off) / p.every)::BIGINT - 1))::INTEGER AS copy, off, p.every, demand, share, slope
  FROM placed p JOIN plan USING (source) WHERE off < demand),
reached AS (SELECT *, (copy * every + off) / demand * share AS q, share * (1 - slope) AS w, 2 * share * slope AS s FROM copies)"""

#: Candidates by the first 16 characters of a passage, wherever they stand in a text.
LEAKS = rf"""WITH words AS (SELECT item_id, list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda w: w <> '') AS w FROM eval_item WHERE item_id IS NOT NULL AND text IS NOT NULL),
plain AS (SELECT item_id, list_transform(w, lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))) AS w FROM words WHERE len(w) >= 13),
passages AS (
  SELECT DISTINCT item_id, p, p[:16] AS head FROM (SELECT item_id, array_to_string(w[i:i + 12], '') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM plain))
  WHERE p <> ''),
texts AS (SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
places AS (SELECT DISTINCT doc_id, t[i:i + 15] AS head FROM (SELECT doc_id, t, unnest(range(1, len(t) - 14)) AS i FROM texts)),
likely AS (SELECT doc_id, item_id, p FROM places JOIN passages USING (head) UNION ALL SELECT doc_id, item_id, p FROM texts, (SELECT * FROM passages WHERE len(p) < 16))
SELECT DISTINCT doc_id, item_id FROM likely JOIN texts USING (doc_id) WHERE contains(t, p)"""

SQL: dict[str, str] = {
    "p8_ascii": LEAKS,
    "p4_closed": _closed(),
    "p9_lengths": f"""{MIXTURE} SELECT source, doc_id, copy, tokens, round(CASE WHEN q <= 0 THEN 0 ELSE 2 * q / (w + sqrt(greatest(w * w + 2 * s * q, 0))) END, 9) AS position FROM reached""",
    "p9_length_shares": f"""{MIXTURE}, taken AS (SELECT source, count(*) FILTER (copy = 0) AS documents, max(copy) + 1 AS most_copies, sum(tokens)::BIGINT AS tokens FROM copies GROUP BY source)
SELECT s.source, round(s.share, 9) AS target_share, s.every AS available_tokens, s.r AS max_repeats, coalesce(documents, 0) AS documents, coalesce(most_copies, 0) AS most_copies,
  coalesce(tokens, 0) AS tokens, round(coalesce(tokens / nullif(sum(tokens) OVER (), 0), 0), 9) AS share, round((SELECT total FROM largest), 3) AS largest_total
FROM stock s LEFT JOIN taken t ON t.source = s.source""",
    "p2_found": f"{RUNS} SELECT object_id, first_event_id, last_event_id FROM runs WHERE n_events > 1",
    "p4_found": f"{TRIPLES} SELECT a AS action_1, b AS action_2, c AS action_3 FROM triples GROUP BY a, b, c HAVING count(*) >= (SELECT n FROM least)",
    "p2_runs": f"{RUNS} SELECT * FROM runs",
}
