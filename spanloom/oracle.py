"""DuckDB SQL for the registered queries, from the same tables."""

from __future__ import annotations

from spanloom.functions import fixed


def _list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# Timed words and segments from conversations, in whole milliseconds.
_WORDS = r"""
t AS (SELECT conv_id AS video_id, turn::int AS seg_idx, unnest(w) AS w0, generate_subscripts(w, 1) - 1 AS p
      FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text, ' '), '\s+'), lambda x: x <> '') AS w FROM (SELECT conv_id, turn, text FROM conversations))),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx, p) - 1 AS n FROM t),
i AS (SELECT *, CASE WHEN n % 41 = 3 THEN '20' WHEN n % 41 = 4 THEN 'de' WHEN n % 41 = 5 THEN 'ani' WHEN n % 43 = 11 THEN 'you' WHEN n % 43 = 12 THEN 'know,'
      WHEN n % 47 = 13 THEN 'Știi' WHEN n % 53 IN (17, 18) THEN 'echo' WHEN n % 59 = 19 THEN 'Ana' WHEN n % 59 = 20 THEN 'Pop' WHEN n % 29 = 6 THEN 'um'
      WHEN n % 211 = 100 THEN 'Aaaaaaaaaaaaaaaaaaaaaaa' ELSE w0 END AS word FROM n),
g AS (SELECT *, CASE WHEN word = 'Aaaaaaaaaaaaaaaaaaaaaaa' THEN 2500 ELSE 90 + 45 * least(8, greatest(1, length(regexp_replace(word, '[^\p{L}\p{N}_]+', '', 'g')))) END AS dur,
      CASE WHEN regexp_matches(word, '[.!?]$') THEN 600 + n * 37 % 5 * 100 WHEN word LIKE '%,' THEN 250 WHEN n % 11 = 0 THEN 800 ELSE n * 13 % 4 * 30 END AS gap FROM i),
st AS (SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY video_id ORDER BY seg_idx, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS st FROM g),
words AS (SELECT video_id, seg_idx, p::int AS word_idx, word, st / 1000.0::double AS start, (st + dur) / 1000.0::double AS "end",
      min(st) OVER s / 1000.0::double AS seg_start, max(st + dur) OVER s / 1000.0::double AS seg_end FROM st WINDOW s AS (PARTITION BY video_id, seg_idx)),
segments AS (SELECT video_id, seg_idx, any_value(seg_start) AS start, any_value(seg_end) AS "end", string_agg(word, ' ' ORDER BY word_idx) AS text FROM words GROUP BY ALL),
ends AS (SELECT video_id, arg_max("end", seg_idx) AS last FROM segments GROUP BY video_id)"""

_WINDOWS = """
grid AS (SELECT video_id, last, unnest(range(0, floor(last / 30)::int + 1))::int AS window_idx FROM ends),
win AS (SELECT video_id, window_idx, (window_idx * 30)::double AS ws, least(window_idx * 30 + 45.0::double, last) AS we FROM grid WHERE window_idx * 30 < last),
links AS (SELECT w.video_id, window_idx, ws AS window_start, we AS window_end, seg_idx, start, s."end", text FROM win w JOIN segments s ON s.video_id = w.video_id AND s."end" >= ws AND s.start <= we),
spans AS (SELECT DISTINCT video_id, window_idx, window_start AS start, window_end AS "end" FROM links)"""

_SUM = " + ".join(f"{w} * greatest(0, least(100, (video_id * 31 + window_idx * 17) % 101 + {5 * d} - 15))" for d, w in enumerate(fixed.CANDIDATE_WEIGHTS.values()))
_SCORED = f"""
odd AS (SELECT *, (video_id * 7 + window_idx * 3) % 23 AS odd FROM spans),
scored AS (SELECT video_id, window_idx, start, "end", odd IN (3, 4, 5) AS bare, CASE WHEN odd IN (3, 4, 5) THEN 0 ELSE greatest(0, least(100, round_even(({_SUM}) / 100.0::double, 0))) END::int AS score FROM odd WHERE odd NOT IN (1, 2))"""

# The greedy choice is a recursion over each recording's ranked windows.
_CANDIDATES = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, window_idx) AS rk FROM scored WHERE score >= 62),
fold(video_id, rk, kept) AS (
  SELECT DISTINCT video_id, 0::bigint, []::STRUCT(w INT, s DOUBLE, e DOUBLE, sc INT)[] FROM ranked
  UNION ALL
  SELECT f.video_id, r.rk, CASE WHEN len(list_filter(kept, lambda x: greatest(0.0::double, least(x.e, r."end") - greatest(x.s, r.start)) / greatest(0.001::double, least(x.e - x.s, r."end" - r.start)) >= 0.72::double)) > 0
    THEN kept ELSE list_append(kept, {'w': r.window_idx, 's': r.start, 'e': r."end", 'sc': r.score}) END
  FROM fold f JOIN ranked r ON r.video_id = f.video_id AND r.rk = f.rk + 1),
full_ AS (SELECT video_id, arg_max(kept, rk) AS kept FROM fold GROUP BY video_id),
cands AS (SELECT video_id, (i - 1)::int AS cand_idx, kept[i].w AS window_idx, kept[i].s AS start, kept[i].e AS "end", kept[i].sc AS score FROM (SELECT video_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM full_)),
best AS (SELECT * FROM cands WHERE cand_idx < 8)"""

_PIECES = """
pieces AS (SELECT video_id, cand_idx, 0 AS seg_pos, start + (video_id + 3) % 12 AS start, start + (video_id + 3) % 12 + 6.5::double AS "end" FROM best
 UNION ALL SELECT video_id, cand_idx, 1, start + (video_id + 9) % 12, start + (video_id + 9) % 12 + 8.25::double FROM best
 UNION ALL SELECT video_id, cand_idx, 2, start + (video_id + 1) % 12, start + (video_id + 1) % 12 + 4.0::double FROM best),
line AS (SELECT video_id, cand_idx, seg_pos AS index, round_even(start, 3) AS source_start, round_even("end", 3) AS source_end,
  round_even(coalesce(sum("end" - start) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS target_start,
  round_even(coalesce(sum("end" - start) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + ("end" - start), 3) AS target_end, 'context' AS role
  FROM pieces WINDOW o AS (PARTITION BY video_id, cand_idx ORDER BY seg_pos))"""


def _pacing(spans: str, key: str, p: str = "") -> str:
    """CTEs that measure ordered words ``ordered`` (key, word, start, end, o) of ``spans`` (key, duration); ``p`` begins their names."""
    return rf"""
{p}tok AS (SELECT *, nullif(regexp_replace(lower(trim(word)), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g'), '') AS token FROM {p}ordered),
{p}seq AS (SELECT *, last_value(token IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lead(start) OVER w AS nxt, greatest(0.0::double, lead(start) OVER w - "end") AS gap FROM {p}tok WINDOW w AS (PARTITION BY {key} ORDER BY o)),
{p}agg AS (SELECT {key}, count(*) AS n, count(*) FILTER (WHERE token IN {_list(fixed.FILLERS)}) AS fillers, count(*) FILTER (WHERE token = before) AS repeats,
  coalesce(sum(round_even(gap * 10000, 0)::bigint) FILTER (WHERE gap >= 0.75::double), 0) / 10000.0::double AS pause FROM {p}seq GROUP BY ALL),
{p}raw AS (SELECT s.*, greatest(0.01::double, s.duration) AS d, coalesce(n, 0) AS n, coalesce(fillers, 0) AS fillers, coalesce(repeats, 0) AS repeats, coalesce(pause, 0.0::double) AS pause FROM {spans} s LEFT JOIN {p}agg USING ({key})),
{p}pace AS (SELECT {key}, round_even(d, 3) AS duration, n AS word_count, round_even(n / d, 3) AS words_per_second, fillers AS filler_count, round_even(fillers / greatest(1, n)::double, 4) AS filler_ratio, repeats AS repeated_word_count, round_even(pause, 3) AS long_pause_seconds,
  round_even(greatest(0, least(100, 100.0::double - least(35.0::double, pause / d * 120.0::double) - least(25.0::double, fillers / greatest(1, n)::double * 180.0::double) - least(15.0::double, repeats / greatest(1, n)::double * 120.0::double)
   - CASE WHEN n / d < 1.45::double THEN least(22.0::double, (1.45::double - n / d) * 18.0::double) WHEN n / d > 4.4::double THEN least(14.0::double, (n / d - 4.4::double) * 6.0::double) ELSE 0.0::double END)), 0)::int AS pacing_score,
  round_even(greatest(0, least(100, 30.0::double + greatest(0, n - fillers - repeats) / d * 20.0::double)), 0)::int AS information_density_proxy FROM {p}raw)"""


_INSIDE = """
durations AS (SELECT video_id, window_idx, "end" - start AS duration FROM spans),
ordered AS (SELECT s.video_id, s.window_idx, word, w.start, w."end", row_number() OVER (PARTITION BY s.video_id, s.window_idx ORDER BY w.start, w."end", seg_idx, word_idx) AS o
  FROM spans s JOIN words w ON w.video_id = s.video_id AND (w.start + w."end") / 2.0::double BETWEEN s.start AND s."end" AND seg_end >= s.start AND seg_start <= s."end")"""

_BASE = _WORDS
_TO_WINDOWS = ",".join([_WORDS, _WINDOWS])
_TO_BEST = ",".join([_WORDS, _WINDOWS, _SCORED, _CANDIDATES])
_TO_PIECES = ",".join([_TO_BEST, _PIECES])
_TO_PACE = ",".join([_TO_WINDOWS, _INSIDE, _pacing("durations", "video_id, window_idx")])
_CONTEXT = """
ctx AS (SELECT *, greatest(0.0::double, cs - 45) AS xs, least(last, ce + 20) AS xe FROM (SELECT video_id, cand_idx, greatest(0.0::double, start) AS cs, least(last, "end") AS ce, last FROM best JOIN ends USING (video_id)))"""
_ITEMS = """
items AS (SELECT video_id, cand_idx, h AS pos, start + (h * 9 + video_id) % 40 AS start, start + (h * 9 + video_id) % 40 + 3 AS "end", (video_id * 7 + h * 31) % 101 AS weight FROM best, (SELECT unnest(range(0, 5))::int AS h)),
mapped AS (SELECT i.video_id, i.cand_idx, pos, weight, index, target_start, greatest(start, source_start) AS lo, least("end", source_end) AS hi, source_start AS ss FROM items i JOIN line l ON l.video_id = i.video_id AND l.cand_idx = i.cand_idx AND least("end", source_end) > greatest(start, source_start)),
moved AS (SELECT video_id, cand_idx, pos, round_even(target_start + (lo - ss), 3) AS start, round_even(target_start + (hi - ss), 3) AS "end", weight, index, round_even(lo, 3) AS source_start, round_even(hi, 3) AS source_end FROM mapped)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


#: Segments of the two catalogues: turns of conversations, and lines of documents.
_TURNS = "(SELECT conv_id, turn, text FROM conversations)"
_LINES = "(SELECT doc_id AS conv_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS turn, unnest(string_split(text, chr(10))) AS text FROM documents)"


def _long(ctes: str, select: str) -> str:
    """The same over lines of documents."""
    return _with(ctes, select).replace(_TURNS, _LINES)


_C = "video_id, cand_idx"
_V = "video_id, cand_idx, variant_pos"

#: Replies that are JSON objects, and the bounds that edits snap to.
_GOOD = f"""{_CONTEXT},
good AS (SELECT b.*, xs, xe, cs, ce FROM best b JOIN ctx USING ({_C}) WHERE b.video_id % 13 <> 0 AND b.video_id % 17 <> 0),
bs AS (SELECT DISTINCT * FROM (SELECT c.video_id, c.cand_idx, s.start AS bound FROM ctx c JOIN segments s ON s.video_id = c.video_id AND s.start <= xe AND s."end" >= xs
  UNION ALL SELECT c.video_id, c.cand_idx, w.start FROM ctx c JOIN words w ON w.video_id = c.video_id AND seg_start <= xe AND seg_end >= xs AND w.start BETWEEN xs AND xe)),
be AS (SELECT DISTINCT * FROM (SELECT c.video_id, c.cand_idx, s."end" AS bound FROM ctx c JOIN segments s ON s.video_id = c.video_id AND s.start <= xe AND s."end" >= xs
  UNION ALL SELECT c.video_id, c.cand_idx, w."end" FROM ctx c JOIN words w ON w.video_id = c.video_id AND seg_start <= xe AND seg_end >= xs AND w."end" BETWEEN xs AND xe))"""

_ROLES = "[" + ", ".join(f"'{r}'" for r in [*fixed.ROLES, "bridge"]) + "]"


def _snapped(table: str, at: str, bounds: str, out: str) -> str:
    """``table`` (with a unique ``id``) and column ``out``: ``at`` at the nearest bound within reach."""
    return f"""(SELECT t.*, coalesce(n.b, t.{at}) AS {out} FROM {table} t LEFT JOIN (SELECT id, min({{'f': abs(bound - {at}), 'b': bound}}).b AS b FROM {table} t JOIN {bounds} b ON b.video_id = t.video_id AND b.cand_idx = t.cand_idx AND abs(bound - {at}) <= {fixed.SNAP_SECONDS}::double GROUP BY id) n USING (id))"""


#: Proposed edits, cut, snapped and merged; variants of an allowed length and every candidate as it is.
_VARIANTS = f"""
prop AS (SELECT row_number() OVER () AS id, * FROM (SELECT video_id, cand_idx, j AS variant_pos, q AS seg_pos, greatest(xs, least(xe, s)) AS s, greatest(xs, least(xe, s + CASE j WHEN 0 THEN 9 + (q * 3 + video_id) % 4 WHEN 2 THEN 8 + q ELSE 1 + (q + j) % 9 END)) AS e, {_ROLES}[(q + j) % 7 + 1] AS role, 'r' || q AS reason
  FROM (SELECT *, CASE j WHEN 0 THEN start + (q * 13 + video_id % 4) WHEN 2 THEN start + (q * 16 + 20) % 36 ELSE start + (q * 11 + j * 7 + video_id) % 40 END + 0.137::double AS s FROM good, (SELECT unnest(range(0, {fixed.MAX_VARIANTS}))::int AS j), (SELECT unnest(range(0, {fixed.MAX_SEGMENTS}))::int AS q)
    WHERE NOT (j = 1 AND video_id % 4 = 0) AND q < CASE j WHEN 0 THEN 2 + video_id % 3 WHEN 2 THEN 3 ELSE 10 END))),
snap1 AS {_snapped("prop", "s", "bs", "s2")},
snap2 AS {_snapped("snap1", "e", "be", "e2")},
long_ AS (SELECT {_V}, seg_pos, round_even(s2, 3) AS s, round_even(e2, 3) AS e, role, reason FROM snap2 WHERE e2 - s2 >= {fixed.MIN_SEGMENT}::double),
once AS (SELECT * FROM (SELECT *, coalesce(lag(s) OVER o = s AND lag(e) OVER o = e, false) AS same FROM long_ WINDOW o AS (PARTITION BY {_V} ORDER BY seg_pos)) WHERE NOT same),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY {_V} ORDER BY seg_pos) AS isle FROM (SELECT *, CASE WHEN s - lag(e) OVER o BETWEEN 0 AND {fixed.MERGE_GAP}::double AND lag(role) OVER o = role THEN 0 ELSE 1 END AS fresh FROM once WINDOW o AS (PARTITION BY {_V} ORDER BY seg_pos))),
merged AS (SELECT {_V}, min(seg_pos) AS seg_pos, arg_min(s, seg_pos) AS start, arg_max(e, seg_pos) AS "end", arg_min(role, seg_pos) AS role, string_agg(reason, '; ' ORDER BY seg_pos) AS reason FROM isle GROUP BY {_V}, isle),
cost AS (SELECT {_V}, sum(round_even(greatest(0.0::double, "end" - start) * 1000, 0)::bigint) / 1000.0::double AS duration, (greatest(0, count(*) - 4) * 1.5 + count(*) FILTER (WHERE start < ps) * 6.0 + count(*) FILTER (WHERE start >= ps AND start - pe > 20) * 2.0)::double AS edit_penalty, min(start) AS clip_start, max("end") AS clip_end, count(*) AS n_pieces
  FROM (SELECT *, lag(start) OVER o AS ps, lag("end") OVER o AS pe FROM merged WINDOW o AS (PARTITION BY {_V} ORDER BY seg_pos)) GROUP BY {_V}),
vars AS (SELECT {_V}, 'v' || variant_pos AS name, 'why ' || variant_pos AS rationale, duration, edit_penalty, clip_start, clip_end, n_pieces FROM cost WHERE duration BETWEEN {fixed.MIN_CLIP * 0.65!r}::double AND {fixed.MAX_CLIP * 1.20!r}::double
  UNION ALL SELECT {_C}, 1000, 'original_fallback', 'original candidate', round_even(greatest(0.0::double, "end" - start), 3), 0.0::double, start, "end", 1 FROM good),
vpieces AS (SELECT m.* FROM merged m SEMI JOIN vars USING ({_V}) UNION ALL SELECT {_C}, 1000, 0, start, "end", 'escalation', 'original_candidate' FROM good)"""

_KEYS = list(fixed.RETENTION_WEIGHTS)


def _reply_score(d: int) -> str:
    own = f"(video_id * 29 + cand_idx * 19 + {13 * d}) % 101"
    odd = {1: f"CASE WHEN video_id % 11 = 0 THEN 85 ELSE {own} END", 2: f"CASE WHEN video_id % 7 = 0 THEN 0 ELSE {own} END", 3: f"CASE WHEN video_id % 5 = 0 THEN 50 ELSE {own} END"}
    return f"(CASE WHEN variant_pos = 0 AND (video_id + cand_idx) % 3 <> 0 THEN 60 + (video_id * 7 + cand_idx * 5 + {11 * d}) % 41 WHEN variant_pos = 2 THEN 40 + (video_id * 3 + cand_idx * 11 + {17 * d}) % 61 ELSE {odd.get(d, own)} END)"


def _blended(d: int) -> str:
    name, own = _KEYS[d], _reply_score(d)
    if name == "pacing":
        own = f"round_even(({own} * 60 + pacing_score * 40) / 100.0::double, 0)"
    if name == "information_density":
        own = f"round_even(({own} * 70 + information_density_proxy * 30) / 100.0::double, 0)"
    return f"{own}::int AS {name}"


_WEIGHED = " + ".join(f"{w} * {k}" for k, w in fixed.RETENTION_WEIGHTS.items())
#: Measured and scored variants, the chosen one of each candidate, and the clips.
_CLIPS = rf"""
vlaid AS (SELECT *, greatest(0.0::double, "end" - start) AS len, coalesce(sum(greatest(0.0::double, "end" - start)) OVER (PARTITION BY {_V} ORDER BY seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double) AS at_ FROM vpieces),
vdur AS (SELECT {_V}, sum(len) AS duration FROM vlaid GROUP BY {_V}),
vordered AS (SELECT p.video_id, p.cand_idx, p.variant_pos, word, at_ + greatest(0.0::double, w.start - p.start) AS start, at_ + least(len, greatest(0.0::double, w."end" - p.start)) AS "end", row_number() OVER (PARTITION BY p.video_id, p.cand_idx, p.variant_pos ORDER BY seg_pos, w.start, w."end", seg_idx, word_idx) AS o
  FROM vlaid p JOIN words w ON w.video_id = p.video_id AND len > 0 AND (w.start + w."end") / 2.0::double BETWEEN p.start AND p."end" AND seg_end >= p.start AND seg_start <= p."end"),
{_pacing("vdur", _V, "v")},
vscored AS (SELECT v.*, {", ".join(_blended(d) for d in range(8))}, word_count FROM vars v JOIN vpace USING ({_V})),
vfinal AS (SELECT *, greatest(0, least(100, round_even(({_WEIGHED} - greatest(0.0::double, edit_penalty) * 100) / 100.0::double, 0)))::int AS retention_score FROM vscored),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY retention_score DESC, variant_pos) AS pl FROM vfinal) WHERE pl = 1),
cpieces AS (SELECT p.* FROM vpieces p SEMI JOIN chosen c USING ({_V})),
clips AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY retention_score DESC, cand_idx)::int AS clip_idx FROM (
  SELECT c.video_id, c.cand_idx, g.window_idx, g.score, round_even(clip_start, 3) AS start, round_even(clip_end, 3) AS "end", round_even(duration, 3) AS duration, 'extractive' AS strategy, 'podcast' AS content_type, rationale, hook AS hook_points, retention_score, n_pieces FROM chosen c JOIN good g USING ({_C})
  UNION ALL SELECT video_id, cand_idx, window_idx, score, start, "end", round_even(greatest(0.0::double, "end" - start), 3), 'extractive_fallback', NULL, 'retention_error', NULL, score, 1 FROM best b WHERE b.video_id % 13 = 0 OR b.video_id % 17 = 0)),
cline AS (SELECT * FROM (SELECT {_C}, (row_number() OVER o - 1)::int AS index, round_even(start, 3) AS source_start, round_even("end", 3) AS source_end, greatest(0.0::double, "end" - start) AS len,
  round_even(coalesce(sum(greatest(0.0::double, "end" - start)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double), 3) AS target_start,
  round_even(coalesce(sum(greatest(0.0::double, "end" - start)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double) + greatest(0.0::double, "end" - start), 3) AS target_end, role FROM cpieces WINDOW o AS (PARTITION BY {_C} ORDER BY seg_pos)) WHERE len > 0)"""

#: Valid cuts of the clips: pieces of 0.05 s or more, or a clip without pieces that is not empty.
_VALID = f"""
cuts AS (SELECT c.video_id, c.cand_idx FROM clips c LEFT JOIN cpieces p ON p.video_id = c.video_id AND p.cand_idx = c.cand_idx WHERE CASE WHEN p.seg_pos IS NULL THEN c."end" > c.start ELSE p."end" - p.start >= 0.05::double END),
exports AS (SELECT video_id, count(DISTINCT cand_idx) AS exported FROM cuts GROUP BY video_id)"""

#: Annotations of the replies and measured pauses, in edited time.
_MAPPED = rf"""
durations AS (SELECT {_C}, ce - cs AS duration FROM ctx),
ordered AS (SELECT s.video_id, s.cand_idx, word, w.start, w."end", row_number() OVER (PARTITION BY s.video_id, s.cand_idx ORDER BY w.start, w."end", seg_idx, word_idx) AS o
  FROM ctx s JOIN words w ON w.video_id = s.video_id AND (w.start + w."end") / 2.0::double BETWEEN cs AND ce AND seg_end >= cs AND seg_start <= ce),
{_pacing("durations", _C)},
pauses AS (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY start, "end") - 1 AS place FROM (SELECT {_C}, round_even("end", 3) AS start, round_even(nxt, 3) AS "end", least(100, round_even(45 + gap * 25, 0)::int) AS weight FROM seq WHERE gap >= 0.75::double)),
noted AS (SELECT video_id, cand_idx, kind, h AS pos, start + (h * 9 + video_id) % 40 AS start, start + (h * 9 + video_id) % 40 + 3 + h % 3 * 4 AS "end",
  CASE kind WHEN 'retention_anchors' THEN (video_id * 7 + h * 31) % 101 WHEN 'retention_risks' THEN (video_id * 11 + h * 17) % 101 WHEN 'open_loops' THEN (video_id * 13 + h * 19) % 101 ELSE (video_id * 17 + h * 23) % 101 END::int AS weight,
  CASE WHEN kind IN ('retention_anchors', 'pattern_interrupts') THEN ['claim', 'payoff', 'story'][h % 3 + 1] END AS type, CASE WHEN kind <> 'open_loops' THEN 'because ' || h END AS reason, CASE WHEN kind = 'open_loops' THEN 'what is w' || h END AS text
  FROM good, (SELECT unnest([0, 1, 2, 3, 4, 6])::int AS h), (SELECT unnest(['retention_anchors', 'retention_risks', 'open_loops', 'pattern_interrupts']) AS kind)
  UNION ALL SELECT video_id, cand_idx, 'retention_risks', (1000000 + place)::int, start, "end", weight, NULL, 'long_pause', NULL FROM pauses),
citems AS (SELECT video_id, cand_idx, kind, pos, round_even(target_start + (lo - source_start), 3) AS start, round_even(target_start + (hi - source_start), 3) AS "end", weight, type, reason, text, index, round_even(lo, 3) AS source_start, round_even(hi, 3) AS source_end, given_start, weight AS given_weight
  FROM (SELECT i.video_id, i.cand_idx, kind, pos, weight, type, reason, text, i.start AS given_start, index, target_start, greatest(i.start, source_start) AS lo, least(i."end", source_end) AS hi, source_start FROM noted i JOIN cline l ON l.video_id = i.video_id AND l.cand_idx = i.cand_idx) WHERE hi > lo),
ccells AS (SELECT {_C}, b AS bucket, (b * 5.0)::double AS start, least(duration, (b + 1) * 5.0::double) AS "end" FROM (SELECT *, unnest(range(0, ceil((duration - 1e-6) / 5.0::double)::int))::int AS b FROM clips WHERE strategy = 'extractive' AND duration > 0)),
cmass AS (SELECT c.video_id, c.cand_idx, bucket, sum(round_even((least(c."end", m."end") - greatest(c.start, m.start)) * 1000, 0)::bigint * weight * CASE WHEN kind = 'retention_anchors' THEN 45 ELSE -55 END)::bigint AS mass
  FROM ccells c JOIN citems m ON m.video_id = c.video_id AND m.cand_idx = c.cand_idx AND kind IN ('retention_anchors', 'retention_risks') AND least(c."end", m."end") > greatest(c.start, m.start) GROUP BY ALL),
cbuckets AS (SELECT c.*, greatest(0, least(100, round_even(60.0::double + coalesce(mass, 0) / (greatest(1, round_even(("end" - start) * 1000, 0)::bigint) * 100)::double, 0)))::int AS score FROM ccells c LEFT JOIN cmass USING ({_C}, bucket)),
ccut AS (SELECT b.video_id, b.cand_idx, b.start AS cs, b."end" AS ce, seg_pos, p.start AS o, greatest(p.start, b.start) AS s, least(p."end", b."end") AS e FROM good b JOIN cpieces p ON p.video_id = b.video_id AND p.cand_idx = b.cand_idx AND p."end" > b.start AND p.start < b."end"),
cgaps AS (SELECT *, greatest(cs, coalesce(max(e) OVER (PARTITION BY {_C} ORDER BY o, seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), cs)) AS at_ FROM ccut),
cremoved AS (SELECT {_C}, round_even(at_, 3) AS start, round_even(s, 3) AS "end", 'not_selected_by_retention_edit' AS reason FROM cgaps WHERE s > at_ + 0.15::double
  UNION ALL SELECT {_C}, round_even(last, 3), round_even(ce, 3), 'not_selected_by_retention_edit' FROM (SELECT b.video_id, b.cand_idx, b."end" AS ce, coalesce(max(e), b.start) AS last FROM good b LEFT JOIN ccut c ON c.video_id = b.video_id AND c.cand_idx = b.cand_idx GROUP BY b.video_id, b.cand_idx, b."end", b.start) WHERE last < ce - 0.15::double)"""

_GIVEN = {"curiosity": "((video_id * 3 + h * 11) % 101)", "relevance": "((video_id * 5 + h * 7) % 101)", "brevity": "brevity"}
_HOOK_SUM = " + ".join(f"{w} * {_GIVEN.get(k, fixed.HOOK_DEFAULTS.get(k))}" for k, w in fixed.HOOK_WEIGHTS.items())
#: Hooks of the replies, normalised and scored.
_HOOKS = f"""
hraw AS (SELECT *, h % 2 = 0 AS generated, (video_id + h) % 6 = 0 AS weak, CASE WHEN (video_id + h) % 5 <> 0 THEN 1 + h % 2 ELSE 0 END::bigint AS n_evidence, 2 * (4 + h * 5) + CASE WHEN (video_id + h) % 6 = 0 THEN 3 ELSE 0 END AS n FROM good, (SELECT unnest(range(0, 5))::int AS h)),
hnum AS (SELECT *, CASE WHEN n <= 8 THEN 100 WHEN n <= 10 THEN 94 WHEN n <= 12 THEN 86 WHEN n <= 14 THEN 70 ELSE greatest(20, 70 - (n - 14) * 8) END::int AS brevity FROM hraw),
hooks AS (SELECT {_C}, h AS hook_pos, CASE WHEN weak THEN 'Did you know ' ELSE '' END || array_to_string(list_transform(range(1, 5 + h * 5), lambda x: 'the w' || x), ' ') AS text, 'question' AS type, generated, 'en' AS language, n_evidence, brevity, ({_GIVEN["curiosity"]})::int AS curiosity,
  greatest(0, least(100, round_even((({_HOOK_SUM}) - CASE WHEN weak THEN 1800 ELSE 0 END - CASE WHEN generated AND n_evidence = 0 THEN 1200 ELSE 0 END) * 100 / 10000.0::double, 0)))::int AS score,
  CASE WHEN NOT generated THEN greatest(xs, least(xe, start + h)) END AS source_start, CASE WHEN NOT generated THEN greatest(xs, least(xe, start + h + 2)) END AS source_end, CASE WHEN generated THEN 'voiceover_tts_candidate' ELSE 'extractive_audio' END AS application, weak, n, start AS cs0
  FROM hnum WHERE generated OR greatest(xs, least(xe, start + h + 2)) > greatest(xs, least(xe, start + h))),
hbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY score - CASE WHEN generated THEN 8 ELSE 0 END DESC, hook_pos) AS pl FROM hooks) WHERE pl = 1),
hvoice AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_C} ORDER BY score DESC, hook_pos) AS pl FROM hooks WHERE generated AND n_evidence > 0 AND NOT weak AND n <= {fixed.VOICE_MAX_WORDS} AND score >= {fixed.VOICE_MIN_SCORE}) WHERE pl = 1)"""

_TO_GOOD = f"{_TO_BEST},{_GOOD}"
_TO_CLIPS = f"{_TO_GOOD},{_VARIANTS},{_CLIPS}"
_TO_ALL = f"{_TO_CLIPS},{_MAPPED},{_HOOKS}"

#: Spoken hooks: the chosen one of each clip with a file, its voice, teaser and last word.
_VOICES = rf"""
filed AS (SELECT * FROM clips WHERE (video_id + clip_idx) % 9 <> 0),
spoken AS (SELECT f.video_id, f.clip_idx, f.cand_idx, f.duration, h.text, h.type, h.score, h.language, h.n, 1.0::double + f.video_id % 37 / 10.0::double AS raw, f.video_id % 10 = 3 AS failed FROM filed f LEFT JOIN hvoice h ON h.video_id = f.video_id AND h.cand_idx = f.cand_idx),
timed AS (SELECT *, text IS NOT NULL AND NOT failed AS applied, CASE WHEN raw <= {fixed.VOICE_SECONDS + 0.02!r}::double THEN raw ELSE {fixed.VOICE_SECONDS!r}::double END AS fit FROM spoken),
top AS (SELECT {_C}, max({{'w': weight::double, 'p': -(pos::bigint * 1048576 + index), 's': start, 'e': "end"}}) AS a FROM citems WHERE kind = 'retention_anchors' GROUP BY {_C}),
tease AS (SELECT t.*, a, least(greatest(0.1::double, fit), greatest(0.1::double, duration)) AS hd FROM timed t LEFT JOIN top USING ({_C})),
teased AS (SELECT *, CASE WHEN a IS NULL THEN 0.0::double ELSE greatest(0.0::double, least(greatest(0.0::double, duration - hd), greatest(a.s, (a.s + a.e) / 2.0::double) - hd / 2.0::double)) END AS ts FROM tease),
wts AS (SELECT video_id, clip_idx, least(8, greatest(1, length(word))) AS k, word, i, fit FROM (SELECT *, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM timed WHERE applied)),
wsum AS (SELECT *, sum(k) OVER (PARTITION BY video_id, clip_idx ORDER BY i)::bigint AS upto, sum(k) OVER (PARTITION BY video_id, clip_idx)::bigint AS total, round_even(fit * 10000, 0)::bigint AS t FROM wts),
wlast AS (SELECT video_id, clip_idx, word AS last_word, total AS n_k, round_even(t * (upto - k) / total::double, 0) / 10000.0::double AS last_start, i AS n_timings FROM wsum WHERE upto = total)"""


_W = "video_id, window_idx"
#: Words of the windows in order.
_WINDOW_WORDS = """
inw AS (SELECT s.video_id, s.window_idx, w.word, w.start, w."end", row_number() OVER (PARTITION BY s.video_id, s.window_idx ORDER BY seg_idx, word_idx) - 1 AS place
  FROM spans s JOIN words w ON w.video_id = s.video_id AND (w.start + w."end") / 2.0::double BETWEEN s.start AND s."end" AND seg_end >= s.start AND seg_start <= s."end")"""


def _ideas(key: str) -> str:
    """The words ``inw`` (key, place, word, start, end) parted at sentences' ends and pauses."""
    return f"""
parted AS (SELECT *, regexp_matches(lag(word) OVER o, '[.!?]["\'\']?$') OR start - lag("end") OVER o >= 0.55::double AS c FROM inw WINDOW o AS (PARTITION BY {key} ORDER BY place)),
ideas AS (SELECT {key}, place, word, start, "end", sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY place)::bigint AS span FROM parted)"""


def _costs(key: str) -> str:
    """What a break after each word costs."""
    return rf"""
w7 AS (SELECT *, count(*) OVER o AS n7, last_value("end") OVER o - first_value(start) OVER o AS long7 FROM ideas WINDOW o AS (PARTITION BY {key}, span ORDER BY place ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
wps AS (SELECT *, CASE WHEN long7 > 0 THEN n7 / long7 ELSE 0.0::double END AS wps,
  regexp_replace(regexp_replace(lower(trim(word)), '^[\s"“”„''()\[\]{{}}]+', ''), '[\s"“”„''()\[\]{{}}.,!?;:]+$', '') AS token, regexp_replace(word, '^[ "''“”„()\[\]{{}}.,!?;:]+|[ "''“”„()\[\]{{}}.,!?;:]+$', '', 'g') AS bare FROM w7),
marks AS (SELECT *, regexp_matches(replace(token, ',', '.'), '^\d+(\.\d+)?%?$') AS number, length(bare) > 1 AND regexp_matches(bare[1], '^\p{{Lu}}') AS capital FROM wps),
near AS (SELECT *, lag(token, 2) OVER o AS b2, lag(token) OVER o AS b1, lead(token) OVER o AS a1, lead(token, 2) OVER o AS a2, lead(token, 3) OVER o AS a3, lead(capital) OVER o AS next_capital, lag(number) OVER o AS prev_number, greatest(0.0::double, lead(start) OVER o - "end") AS pause FROM marks WINDOW o AS (PARTITION BY {key}, span ORDER BY place)),
rated AS (SELECT *, list_has_any([token || ' ' || a1, b1 || ' ' || token || ' ' || a1, token || ' ' || a1 || ' ' || a2, b2 || ' ' || b1 || ' ' || token || ' ' || a1, b1 || ' ' || token || ' ' || a1 || ' ' || a2, token || ' ' || a1 || ' ' || a2 || ' ' || a3], [{", ".join(f"'{x}'" for x in fixed.PHRASES)}]) AS phrase,
  capital AND next_capital AND token NOT IN {_list(fixed.ENDERS)} AND a1 NOT IN {_list(fixed.STARTERS)} AS named, (number AND (a1 IN {_list(fixed.UNITS)} OR a1 = 'de')) OR (coalesce(prev_number, false) AND token = 'de' AND a1 IN {_list(fixed.UNITS)}) AS counted FROM near),
breaks AS (SELECT {key}, place::int AS place, word, start, "end", span, token, CASE WHEN wps >= 3.10::double THEN 3 ELSE 2 END AS ideal_words, (CASE WHEN wps >= 3.10::double THEN 0.95 WHEN wps <= 1.75::double THEN 1.35 ELSE 1.15 END)::double AS ideal_duration, (CASE WHEN wps >= 3.10::double THEN 1.45 WHEN wps <= 1.75::double THEN 1.85 ELSE 1.65 END)::double AS max_duration,
  CASE WHEN a1 IS NULL THEN NULL WHEN phrase OR named OR counted THEN 100.0::double ELSE (CASE WHEN pause >= 0.55::double THEN -6.0 WHEN pause >= 0.35::double THEN -4.0 WHEN pause >= 0.18::double THEN -1.8 WHEN pause < 0.05::double THEN 0.35 ELSE 0 END)::double + (CASE WHEN regexp_matches(word, '[.!?]["'']?$') THEN -7.0 WHEN regexp_matches(word, '[,;:]\s*$') THEN -2.2 ELSE 0 END)::double
   + (CASE WHEN token IN {_list(fixed.ENDERS)} THEN 3.6 ELSE 0 END)::double + (CASE WHEN a1 IN {_list(fixed.STARTERS)} THEN 3.0 ELSE 0 END)::double + (CASE WHEN token IN {_list(fixed.ENDERS)} AND length(token) <= 2 THEN 1.0 ELSE 0 END)::double END AS cost FROM rated)"""


def _group_cost(n: int) -> str:
    last = lambda c: f"lead({c}, {n - 1}) OVER o" if n > 1 else c
    d = f"""({last('"end"')} - start)"""
    single = """ + 1.15::double - (CASE WHEN ("end" - start) >= 0.70::double THEN 0.65 ELSE 0 END)::double - (CASE WHEN regexp_matches(word, '[.!?]["\'\']?$') THEN 0.45 ELSE 0 END)::double"""
    own = f"""abs({n} - {last("ideal_words")}) * 1.15::double{single if n == 1 else ""} + abs({d} - {last("ideal_duration")}) * 1.25::double + CASE WHEN {d} < 0.38::double THEN (0.38::double - {d}) * 6.0::double ELSE 0.0::double END
     + (CASE WHEN token IN {_list(fixed.STARTERS)} AND row_number() OVER o > 1 THEN 1.6 ELSE 0 END)::double + (CASE WHEN {last("token")} IN {_list(fixed.ENDERS)} AND {last("cost")} IS NOT NULL THEN 2.1 ELSE 0 END)::double + coalesce({last("cost")}, 0.0::double)"""
    too_long = f"{d} > {1.85 + 0.30!r}::double" + (f" OR {d} > {last('max_duration')}" if n > 1 else "")
    return f"""CASE WHEN {last('"end"')} IS NULL OR {too_long} THEN 'infinity'::double ELSE {own} END AS c{n}"""


def _groups(key: str) -> str:
    """Captions: the cheapest split of each span by a recursion from its end, then a fold that joins short single words."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key.split(", "))
    fits = lambda a, b: f"{a}.n + {b}.n <= 3 AND {b}.e - {a}.s <= 1.85::double AND {b}.s - {a}.e < 0.55::double"
    both = lambda a, b: f"{{'a': {a}.a, 'n': {a}.n + {b}.n, 's': {a}.s, 'e': {b}.e}}"
    short = "len(gs) > 1 AND gs[j].n = 1 AND greatest(0.0::double, gs[j].e - gs[j].s) < 0.65::double"
    back, ahead = f"({short} AND len(done) > 0 AND {fits('done[-1]', 'gs[j]')})", f"({short} AND j < len(gs) AND {fits('gs[j]', 'gs[j + 1]')})"
    return f"""
priced AS (SELECT *, {", ".join(_group_cost(n) for n in (1, 2, 3))} FROM breaks WINDOW o AS (PARTITION BY {key}, span ORDER BY place)),
lists AS (SELECT {key}, span, min(place) AS p0, count(*) AS n, list(c1 ORDER BY place) AS c1, list(c2 ORDER BY place) AS c2, list(c3 ORDER BY place) AS c3 FROM priced GROUP BY {key}, span),
dp AS (SELECT {key}, span, p0, n, c1, c2, c3, n AS i, 0.0::double AS t0, 'infinity'::double AS t1, 'infinity'::double AS t2, []::INT[] AS sizes FROM lists
 UNION ALL SELECT {key}, span, p0, n, c1, c2, c3, i - 1, least(c1[i] + t0, c2[i] + t1, c3[i] + t2), t0, t1,
   list_prepend(CASE WHEN least(c1[i] + t0, c2[i] + t1, c3[i] + t2) = 'infinity'::double THEN 0 WHEN c1[i] + t0 <= least(c2[i] + t1, c3[i] + t2) THEN 1 WHEN c2[i] + t1 <= c3[i] + t2 THEN 2 ELSE 3 END, sizes) FROM dp WHERE i > 0),
walk AS (SELECT {key}, span, p0, n, sizes, 1::bigint AS i, 0 AS k FROM dp WHERE i = 0
 UNION ALL SELECT {key}, span, p0, n, sizes, i + k, CASE WHEN sizes[1] = 0 OR i + k > n THEN 1 ELSE greatest(1, sizes[i + k]) END FROM walk WHERE i + k <= n),
firsts AS (SELECT {key}, span, p0 + i - 1 AS a, k AS n FROM walk WHERE k > 0),
spans_of AS (SELECT f.*, x.start AS s, y."end" AS e FROM firsts f JOIN priced x ON {same("x", "f")} AND x.place = f.a JOIN priced y ON {same("y", "f")} AND y.place = f.a + f.n - 1),
given_groups AS (SELECT {key}, list({{'a': a::bigint, 'n': n::bigint, 's': s, 'e': e}} ORDER BY a) AS gs FROM spans_of GROUP BY {key}),
joined AS (SELECT {key}, gs, 1::bigint AS j, []::STRUCT(a BIGINT, n BIGINT, s DOUBLE, e DOUBLE)[] AS done FROM given_groups
 UNION ALL SELECT {key}, gs, CASE WHEN NOT {back} AND {ahead} THEN j + 2 ELSE j + 1 END,
   CASE WHEN {back} THEN list_append(done[:-2], {both("done[-1]", "gs[j]")}) WHEN {ahead} THEN list_append(done, {both("gs[j]", "gs[j + 1]")}) ELSE list_append(done, gs[j]) END FROM joined WHERE j <= len(gs)),
numbered AS (SELECT {key}, g - 1 AS group_idx, done[g] AS d FROM (SELECT *, unnest(range(1, len(done) + 1)) AS g FROM joined WHERE j > len(gs))),
captions AS (SELECT c.*, list({{'w': p.word, 's': p.start, 'e': p."end"}} ORDER BY place) AS ws FROM numbered c JOIN priced p ON {same("p", "c")} AND p.place >= c.d.a AND p.place < c.d.a + c.d.n GROUP BY ALL)"""


def _escaped(w: str) -> str:
    return rf"replace(replace(replace({w}, '\', '\\'), '{{', '\{{'), '}}', '\}}')"


def _events(key: str, animation: str = "capcut") -> str:
    """An event per word of every caption."""
    plain = f"'{{\\c{fixed.PLAIN_COLOR}\\fscx100\\fscy100}}' || {_escaped('x.w')}"
    lit = f"'{{\\c{fixed.ACTIVE_COLOR}}}{fixed.WORD_TAGS[animation]}' || {_escaped('x.w')} || '{fixed.RESET_TAG}'"
    return f"""
each AS (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM captions),
events AS (SELECT {key}, group_idx, (k - 1)::int AS active_index, ws[k].s AS start, ws[k].s + greatest(0.01::double, greatest(ws[k].e, coalesce(ws[k + 1].s, ws[-1].e)) - ws[k].s) AS "end", ws[k].w AS word, array_to_string(list_transform(ws, lambda x, i: CASE WHEN i = k THEN {lit} ELSE {plain} END), ' ') AS text FROM each)"""


def _clock(t: str) -> str:
    """H:MM:SS.CC of seconds."""
    t = f"greatest(0.0::double, {t})"
    cs = f"(floor({t})::bigint * 100 + round_even(({t} - floor({t})) * 100, 0)::bigint)"
    return f"({cs} // 360000) || ':' || lpad(({cs} % 360000 // 6000)::varchar, 2, '0') || ':' || lpad(({cs} % 6000 // 100)::varchar, 2, '0') || '.' || lpad(({cs} % 100)::varchar, 2, '0')"


#: Words of every clip: part 0 the spoken hook, part 1 the clip's own words, moved behind it.
_CLIP_WORDS = f"""
hooked AS (SELECT c.*, fit FROM clips c LEFT JOIN (SELECT video_id, clip_idx, fit FROM timed WHERE applied) t USING (video_id, clip_idx)),
cput AS (SELECT p.*, h.clip_idx, h.fit, p."end" - p.start AS len, coalesce(sum(p."end" - p.start) OVER (PARTITION BY p.video_id, p.cand_idx ORDER BY seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double) AS at_ FROM cpieces p JOIN hooked h USING ({_C})),
cmet AS (SELECT p.video_id, p.clip_idx, fit, seg_pos, seg_idx, word_idx, word, at_, len, greatest(0.0::double, w.start - p.start) AS lo, w."end" - p.start AS hi, row_number() OVER (PARTITION BY p.video_id, p.clip_idx, seg_pos, round_even(w.start, 4), round_even(w."end", 4), word ORDER BY seg_idx, word_idx) AS twin
  FROM cput p JOIN words w ON w.video_id = p.video_id AND (w.start + w."end") / 2.0::double BETWEEN p.start AND p."end" AND seg_end >= p.start AND seg_start <= p."end"),
cown AS (SELECT video_id, clip_idx, fit, seg_pos, seg_idx, word_idx, word, round_even(at_ + lo, 4) AS s, round_even(at_ + least(len, greatest(lo, hi)), 4) AS e FROM cmet WHERE twin = 1
 UNION ALL SELECT h.video_id, h.clip_idx, fit, 0, seg_idx, word_idx, word, w.start - h.start, w."end" - h.start FROM hooked h JOIN words w ON h.strategy <> 'extractive' AND w.video_id = h.video_id AND w."end" >= h.start AND w.start <= h."end"),
cwords AS (SELECT video_id, clip_idx, 1 AS part, seg_pos, seg_idx, word_idx, word, round_even(s + coalesce(fit, 0.0::double), 4) AS start, round_even(e + coalesce(fit, 0.0::double), 4) AS "end" FROM cown
 UNION ALL SELECT video_id, clip_idx, 0, 0, 0, i, word, round_even(t * (upto - k) / total::double, 0) / 10000.0::double, CASE WHEN upto = total THEN t ELSE greatest(round_even(t * (upto - k) / total::double, 0) + 100, round_even(t * upto / total::double, 0)) END / 10000.0::double FROM wsum),
inw AS (SELECT video_id, clip_idx, part, row_number() OVER (PARTITION BY video_id, clip_idx, part ORDER BY seg_pos, seg_idx, word_idx) - 1 AS place, word, start, greatest(start, "end") AS "end" FROM cwords)"""
_P = "video_id, clip_idx, part"


#: Crop tracks of whole clips: w and h are the crop's, the largest even 9:16 part of the frame; (x, y) is a box's corner.
_CROP = """
sizes AS (SELECT video_id, cand_idx AS clip_idx, "end" - start AS duration, floor(("end" - start + 0.001::double) * 2)::int AS top, [1920, 1080, 1279, 1000, 202][video_id % 5 + 1] AS fw, [1080, 1920, 719, 1000, 360][video_id % 5 + 1] AS fh FROM best),
framed AS (SELECT *, CASE WHEN fw / fh::double >= 0.5625::double THEN least(fw, even_w - even_w % 2) ELSE fw END AS w, CASE WHEN fw / fh::double >= 0.5625::double THEN fh ELSE least(fh, even_h - even_h % 2) END AS h FROM (SELECT *, round_even(fh * 0.5625::double, 0)::int AS even_w, round_even(fw / 0.5625::double, 0)::int AS even_h FROM sizes)),
raw_track AS (SELECT video_id, clip_idx, duration, top, fw, fh, w, h, -1 AS i, NULL::double AS lx, NULL::double AS ly, ''::varchar AS source FROM framed
 UNION ALL SELECT video_id, clip_idx, duration, top, fw, fh, w, h, i + 1,
   greatest(w / 2.0::double, least(CASE WHEN face THEN CASE WHEN second THEN x + 200 ELSE x END + s / 2 WHEN person THEN x + 50 + s / 2 ELSE coalesce(lx, fw / 2.0::double) END, fw - w / 2.0::double)),
   greatest(h / 2.0::double, least(CASE WHEN face THEN y + s * 0.72::double WHEN person THEN y + s * 0.42::double ELSE coalesce(ly, fh / 2.0::double) END, fh - h / 2.0::double)),
   CASE WHEN face THEN 'face' WHEN person THEN 'person' WHEN lx IS NULL THEN 'center' ELSE 'previous' END
  FROM (SELECT *, two AND lx IS NOT NULL AND sqrt((x + 200 + s / 2 - lx) ** 2 + (y + s / 2 - ly) ** 2) - 0.2::double * s < sqrt((x + s / 2 - lx) ** 2 + (y + s / 2 - ly) ** 2) - 0.2::double * s AS second
    FROM (SELECT *, (video_id + i + 1) % 6 <> 0 AS face, (i + 1) % 5 = 0 AS two, (video_id + i + 1) % 4 <> 0 AS person, ((video_id * 37 + (i + 1) * 29) % 1500)::double AS x, ((video_id * 17 + (i + 1) * 11) % 700)::double AS y, (80 + (i + 1) % 3 * 40)::double AS s FROM raw_track WHERE i < top))),
track AS (SELECT video_id, clip_idx, fw, fh, w, h, i AS n, i * 0.5::double AS time, lx AS at_x, ly AS at_y, source FROM raw_track WHERE i >= 0
 UNION ALL SELECT video_id, clip_idx, fw, fh, w, h, i + 1, duration, lx, ly, source FROM raw_track WHERE i = top AND i * 0.5::double < duration),
calm AS (SELECT video_id, clip_idx, fw, fh, w, h, n, time, at_x AS center_x, at_y AS center_y, source FROM track WHERE n = 0
 UNION ALL SELECT t.video_id, t.clip_idx, t.fw, t.fh, t.w, t.h, t.n, t.time,
   greatest(t.w / 2.0::double, least(CASE WHEN abs(at_x - center_x) <= t.w * 0.07::double THEN center_x ELSE center_x + greatest(-(t.w * 0.18::double), least(t.w * 0.18::double, at_x - center_x)) * 0.32::double END, t.fw - t.w / 2.0::double)),
   greatest(t.h / 2.0::double, least(CASE WHEN abs(at_y - center_y) <= t.h * 0.07::double THEN center_y ELSE center_y + greatest(-(t.h * 0.18::double), least(t.h * 0.18::double, at_y - center_y)) * 0.32::double END, t.fh - t.h / 2.0::double)), t.source
  FROM calm c JOIN track t ON t.video_id = c.video_id AND t.clip_idx = c.clip_idx AND t.n = c.n + 1),
corners AS (SELECT video_id, clip_idx, n, time, center_x, center_y, source, greatest(0.0::double, least((fw - w)::double, center_x - w / 2.0::double)) AS x, greatest(0.0::double, least((fh - h)::double, center_y - h / 2.0::double)) AS y FROM calm)"""


def _case(values: list[str], by: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{by}]"


#: The head of a subtitle document in the default style.
_HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: 1080
PlayResY: 1920

[V4+ Styles]

Format: Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding
Style: Default,Anton,92,&H00FFFFFF,&H0000FFFF,&H00000000,&H64000000,-1,0,0,0,100,100,0,0,1,4,1,2,70,70,140,1

[Events]

Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text
"""

_ITEM_KINDS = ["retention_anchors", "retention_risks", "open_loops", "pattern_interrupts"]


def _told(*fields: str, order: str) -> str:
    """A digest ``told`` of a group's rows in order, with a dash for nulls."""
    line = " || '|' || ".join(f"coalesce({f}, '-')" for f in fields)
    return f"md5(string_agg({line}, ';' ORDER BY {order})) AS told"


SQL: dict[str, str] = {
    "timed_words": _with(_BASE, "SELECT * FROM words"),
    "timed_segments": _with(_BASE, "SELECT * FROM segments"),
    "sliding_windows": _with(_TO_WINDOWS, "SELECT video_id, window_idx, window_start, window_end, seg_idx FROM links"),
    "window_text": _with(_TO_WINDOWS, """SELECT video_id, window_idx, any_value(window_start) AS start, any_value(window_end) AS "end", string_agg(printf('[%.1fs - %.1fs] %s' || chr(10), round_even(start, 1), round_even("end", 1), text), '' ORDER BY seg_idx) AS text FROM links GROUP BY ALL"""),
    "window_scores": _with(",".join([_TO_WINDOWS, _SCORED]), "SELECT video_id, window_idx, CASE WHEN bare THEN 'Untitled' ELSE 'Window ' || window_idx END AS title, CASE WHEN bare THEN 0 ELSE greatest(0, least(100, (video_id * 31 + window_idx * 17) % 101 - 15)) END::int AS hook, CASE WHEN bare THEN 0 ELSE greatest(0, least(100, (video_id * 31 + window_idx * 17) % 101 + 15)) END::int AS density, score FROM scored"),
    "candidates": _with(_TO_BEST, "SELECT * FROM cands"),
    "context_segments": _with(
        f"{_TO_BEST},{_CONTEXT}",
        """SELECT video_id, cand_idx, section, seg_idx FROM (SELECT c.video_id, c.cand_idx, seg_idx, unnest([CASE WHEN s."end" >= xs AND start <= cs THEN 'before' END, CASE WHEN s."end" >= cs AND start <= ce THEN 'candidate' END, CASE WHEN s."end" >= ce AND start <= xe THEN 'after' END, 'all']) AS section
        FROM ctx c JOIN segments s ON s.video_id = c.video_id AND s."end" >= xs AND s.start <= xe) WHERE section IS NOT NULL""",
    ),
    "pacing_windows": _with(_TO_PACE, "SELECT * FROM pace"),
    "pacing_risks": _with(_TO_PACE, """SELECT video_id, window_idx, round_even("end", 3) AS start, round_even(nxt, 3) AS "end", 'long_pause' AS reason, least(100, round_even(45 + gap * 25, 0)::int) AS severity FROM seq WHERE gap >= 0.75::double"""),
    "best_windows": _with(_TO_PACE, "SELECT video_id, place::int AS place, window_idx, word_count, pacing_score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pacing_score DESC, word_count DESC, window_idx) AS place FROM pace) WHERE place <= 3"),
    "edit_timeline": _with(_TO_PIECES, "SELECT * FROM line"),
    "edit_costs": _with(
        _TO_PIECES,
        f"""SELECT {_C}, 0 AS variant_pos, sum(round_even(("end" - start) * 1000, 0)::bigint) / 1000.0::double AS duration, (greatest(0, count(*) - 4) * 1.5 + count(*) FILTER (WHERE start < ps) * 6.0 + count(*) FILTER (WHERE start >= ps AND start - pe > 20) * 2.0)::double AS edit_penalty, min(start) AS clip_start, max("end") AS clip_end, count(*) AS n_pieces
        FROM (SELECT *, lag(start) OVER o AS ps, lag("end") OVER o AS pe FROM pieces WINDOW o AS (PARTITION BY {_C} ORDER BY seg_pos)) GROUP BY {_C}""",
    ),
    "edit_times": _with(_TO_PIECES, f"""SELECT p.video_id, p.cand_idx, p.seg_pos AS point, p.start + 2.5::double AS t, (SELECT arg_min(target_start + (p.start + 2.5::double - source_start), index) FROM line l WHERE l.video_id = p.video_id AND l.cand_idx = p.cand_idx AND p.start + 2.5::double BETWEEN source_start AND source_end) AS target FROM pieces p"""),
    "edit_items": _with(f"{_TO_PIECES},{_ITEMS}", "SELECT * FROM moved"),
    "edit_buckets": _with(
        f"""{_TO_PIECES},{_ITEMS},
        lens AS (SELECT {_C}, sum(round_even(("end" - start) * 1000, 0)) / 1000 AS duration FROM pieces GROUP BY {_C}),
        cells AS (SELECT {_C}, b AS bucket, (b * 5.0)::double AS start, least(duration, (b + 1) * 5.0::double) AS "end" FROM (SELECT *, unnest(range(0, ceil((duration - 1e-6) / 5.0)::int))::int AS b FROM lens)),
        mass AS (SELECT c.video_id, c.cand_idx, bucket, sum(round_even((least(c."end", m."end") - greatest(c.start, m.start)) * 1000, 0)::bigint * weight * CASE WHEN pos % 2 = 0 THEN 45 ELSE -55 END)::bigint AS mass FROM cells c JOIN moved m ON m.video_id = c.video_id AND m.cand_idx = c.cand_idx AND least(c."end", m."end") > greatest(c.start, m.start) GROUP BY ALL),
        marks AS (SELECT c.*, greatest(0, least(100, round_even(60.0::double + coalesce(mass, 0) / (greatest(1, round_even(("end" - start) * 1000, 0)::bigint) * 100)::double, 0)))::int AS score FROM cells c LEFT JOIN mass USING ({_C}, bucket))""",
        f"""SELECT {_C}, bucket, round_even(start, 3) AS start, round_even("end", 3) AS "end", score, CASE WHEN score >= 80 THEN 'very_good' WHEN score >= 65 THEN 'good' WHEN score >= 45 THEN 'medium' ELSE 'retention_hole' END AS label FROM marks""",
    ),
    "edit_removed": _with(
        f"""{_TO_PIECES},
        cut AS (SELECT b.video_id, b.cand_idx, b.start AS cs, b."end" AS ce, seg_pos, p.start AS o, greatest(p.start, b.start) AS s, least(p."end", b."end") AS e FROM best b JOIN pieces p ON p.video_id = b.video_id AND p.cand_idx = b.cand_idx AND p."end" > b.start AND p.start < b."end"),
        gaps AS (SELECT *, greatest(cs, coalesce(max(e) OVER (PARTITION BY {_C} ORDER BY o, seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), cs)) AS at_ FROM cut)""",
        f"""SELECT {_C}, round_even(at_, 3) AS start, round_even(s, 3) AS "end", 'not_selected_by_retention_edit' AS reason FROM gaps WHERE s > at_ + 0.15::double
        UNION ALL SELECT {_C}, round_even(last, 3), round_even(ce, 3), 'not_selected_by_retention_edit' FROM (SELECT b.video_id, b.cand_idx, b."end" AS ce, coalesce(max(e), b.start) AS last FROM best b LEFT JOIN cut c ON c.video_id = b.video_id AND c.cand_idx = b.cand_idx GROUP BY b.video_id, b.cand_idx, b."end", b.start) WHERE last < ce - 0.15::double""",
    ),
    "clip_words": _with(_TO_BEST, """SELECT b.video_id, b.cand_idx, seg_idx, word_idx, word, w.start - b.start AS start, w."end" - b.start AS "end" FROM best b JOIN words w ON w.video_id = b.video_id AND w."end" >= b.start AND w.start <= b."end\""""),
    "edit_words": _with(
        f"""{_TO_PIECES},
        put AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY {_C} ORDER BY seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM pieces),
        met AS (SELECT p.video_id, p.cand_idx, seg_pos, seg_idx, word_idx, word, at_, p."end" - p.start AS len, greatest(0.0::double, w.start - p.start) AS lo, w."end" - p.start AS hi, row_number() OVER (PARTITION BY p.video_id, p.cand_idx, seg_pos, round_even(w.start, 4), round_even(w."end", 4), word ORDER BY seg_idx, word_idx) AS twin
          FROM put p JOIN words w ON w.video_id = p.video_id AND (w.start + w."end") / 2.0::double BETWEEN p.start AND p."end" AND seg_end >= p.start AND seg_start <= p."end")""",
        f"""SELECT {_C}, seg_pos, seg_idx, word_idx, word, round_even(at_ + lo, 4) AS start, round_even(at_ + least(len, greatest(lo, hi)), 4) AS "end" FROM met WHERE twin = 1""",
    ),
    "voice_timings": _with(
        r"""%s,
        w AS (SELECT video_id, seg_idx, greatest(0.01::double, "end" - start) AS d, unnest(a) AS word, generate_subscripts(a, 1) - 1 AS w_idx FROM (SELECT *, regexp_split_to_array(trim(text), '\s+') AS a FROM segments)),
        x AS (SELECT *, least(8, greatest(1, length(regexp_replace(word, '[^\p{L}\p{N}_]+', '', 'g')))) AS k FROM w),
        y AS (SELECT *, sum(k) OVER (PARTITION BY video_id, seg_idx ORDER BY w_idx)::bigint AS upto, sum(k) OVER (PARTITION BY video_id, seg_idx)::bigint AS total FROM x)""" % _WORDS,
        """SELECT video_id, seg_idx, w_idx::int AS w_idx, word, round_even(t * (upto - k) / total::double, 0) / 10000.0::double AS start, CASE WHEN upto = total THEN t ELSE greatest(round_even(t * (upto - k) / total::double, 0) + 100, round_even(t * upto / total::double, 0)) END / 10000.0::double AS "end" FROM (SELECT *, round_even(d * 10000, 0)::bigint AS t FROM y)""",
    ),
    "idea_spans": _with(f"{_TO_WINDOWS},{_WINDOW_WORDS},{_ideas(_W)}", f"""SELECT {_W}, place::int AS place, word, start, "end", span FROM ideas"""),
    "text_functions": _with(
        _BASE,
        rf"""SELECT video_id, seg_idx, n AS n_words, (CASE WHEN n <= 0 THEN 0 WHEN n <= 8 THEN 100 WHEN n <= 10 THEN 94 WHEN n <= 12 THEN 86 WHEN n <= 14 THEN 70 ELSE greatest(20, 70 - (n - 14) * 8) END)::bigint AS brevity,
        CASE WHEN regexp_matches(p, '[ăâîșț]') OR {" + ".join(f"contains(p, ' {w} ')::int" for w in fixed.RO_HINTS)} > {" + ".join(f"contains(p, ' {w} ')::int" for w in fixed.EN_HINTS)} THEN 'ro' ELSE 'en' END AS language,
        regexp_matches(lower(text), '^(?:{"|".join(w.replace("'", "''") for w in fixed.WEAK_PREFIXES)})') AS weak, replace(replace(replace(text, '\', '\\'), '{{', '\{{'), '}}', '\}}') AS escaped
        FROM (SELECT *, ' ' || lower(text) || ' ' AS p, len(regexp_split_to_array(trim(text), '\s+'))::bigint AS n FROM segments)""",
    ),
    "discovered": _with(_TO_BEST, """SELECT video_id, cand_idx, window_idx, 'Window ' || window_idx AS title, start, "end", score FROM cands"""),
    "context_text": _with(
        f"""{_TO_BEST},{_CONTEXT},
        hundredths AS (SELECT *, a // 10 + CASE WHEN a % 10 > 5 OR (a % 10 = 5 AND a // 10 % 2 = 1) THEN 1 ELSE 0 END AS h1, z // 10 + CASE WHEN z % 10 > 5 OR (z % 10 = 5 AND z // 10 % 2 = 1) THEN 1 ELSE 0 END AS h2 FROM (SELECT *, round(start * 1000)::bigint AS a, round("end" * 1000)::bigint AS z FROM segments)),
        met AS (SELECT c.video_id, c.cand_idx, seg_idx, printf('[%d.%02d-%d.%02d] %s', h1 // 100, h1 % 100, h2 // 100, h2 % 100, trim(text)) AS line, s."end" >= xs AND start <= cs AS b, s."end" >= cs AND start <= ce AS c, s."end" >= ce AND start <= xe AS a FROM ctx c JOIN hundredths s ON s.video_id = c.video_id AND s."end" >= xs AND s.start <= xe AND trim(text) <> ''),
        three AS (SELECT {_C}, concat_ws(chr(10), 'CONTEXT_BEFORE', string_agg(line, chr(10) ORDER BY seg_idx) FILTER (WHERE b)) AS b, concat_ws(chr(10), 'CANDIDATE', string_agg(line, chr(10) ORDER BY seg_idx) FILTER (WHERE c)) AS c, concat_ws(chr(10), 'CONTEXT_AFTER', string_agg(line, chr(10) ORDER BY seg_idx) FILTER (WHERE a)) AS a FROM ctx LEFT JOIN met USING ({_C}) GROUP BY {_C}),
        full_text AS (SELECT *, concat_ws(chr(10) || chr(10), b, c, a) AS payload, floor(greatest(0, {fixed.CONTEXT_CHARS} - length(c) - 20) / 2)::int AS half FROM three),
        cut AS (SELECT {_C}, CASE WHEN length(payload) <= {fixed.CONTEXT_CHARS} THEN payload ELSE left(CASE WHEN half > 0 THEN right(b, half) ELSE '' END || chr(10) || chr(10) || c || chr(10) || chr(10) || CASE WHEN half > 0 THEN left(a, half) ELSE '' END, {fixed.CONTEXT_CHARS}) END AS text FROM full_text)""",
        f"SELECT {_C}, length(text)::bigint AS n_chars, md5(text) AS text_md5 FROM cut",
    ),
    "pacing_edits": _with(
        f"""{_TO_PIECES},
        laid AS (SELECT *, "end" - start AS len, coalesce(sum("end" - start) OVER (PARTITION BY {_C} ORDER BY seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double) AS at_ FROM pieces),
        durations AS (SELECT {_C}, sum(len) AS duration FROM laid GROUP BY {_C}),
        ordered AS (SELECT p.video_id, p.cand_idx, word, at_ + greatest(0.0::double, w.start - p.start) AS start, at_ + least(len, greatest(0.0::double, w."end" - p.start)) AS "end", row_number() OVER (PARTITION BY p.video_id, p.cand_idx ORDER BY seg_pos, w.start, w."end", seg_idx, word_idx) AS o
          FROM laid p JOIN words w ON w.video_id = p.video_id AND (w.start + w."end") / 2.0::double BETWEEN p.start AND p."end" AND seg_end >= p.start AND seg_start <= p."end"),
        {_pacing("durations", _C)}""",
        "SELECT * FROM pace",
    ),
    "edit_bounds": _with(_TO_GOOD, f"SELECT {_C}, bound, 'start' AS side FROM bs UNION ALL SELECT {_C}, bound, 'end' FROM be"),
    "snapped_points": _with(f"{_TO_PIECES},{_GOOD}, points AS (SELECT row_number() OVER () AS id, {_C}, seg_pos, start AS s FROM pieces), moved AS {_snapped('points', 's', 'bs', 'at_')}", f"SELECT {_C}, seg_pos, at_ AS at FROM moved"),
    "hook_scores": _with(f"{_TO_GOOD},{_HOOKS}", f"SELECT {_C}, hook_pos, text, type, generated, language, n_evidence, brevity, curiosity, score, source_start, source_end, application FROM hooks"),
    "hook_best": _with(f"{_TO_GOOD},{_HOOKS}", f"SELECT {_C}, hook_pos, score, generated FROM hbest"),
    "hook_voice": _with(f"{_TO_GOOD},{_HOOKS}", f"SELECT {_C}, hook_pos, score, text FROM hvoice"),
    "variant_pieces": _with(f"{_TO_GOOD},{_VARIANTS}", f'SELECT {_V}, seg_pos, start, "end", role, reason FROM vpieces'),
    "variant_scores": _with(_TO_CLIPS, f"SELECT {_V}, name, duration, edit_penalty, {', '.join(_KEYS)}, word_count, retention_score FROM vfinal"),
    "clips": _with(_TO_CLIPS, f"""SELECT {_C}, clip_idx, cand_idx + 1 AS debug_index, 'Window ' || window_idx AS title, start, "end", duration, strategy, content_type, rationale, hook_points, retention_score, n_pieces FROM clips"""),
    "clip_segments": _with(_TO_CLIPS, f'SELECT {_C}, seg_pos, start, "end", role, reason FROM cpieces'),
    "clip_timeline": _with(_TO_CLIPS, f"SELECT {_C}, index, source_start, source_end, target_start, target_end, role FROM cline"),
    "clip_items": _with(_TO_ALL, "SELECT * FROM citems"),
    "clip_buckets": _with(_TO_ALL, f"""SELECT {_C}, bucket, round_even(start, 3) AS start, round_even("end", 3) AS "end", score, CASE WHEN score >= 80 THEN 'very_good' WHEN score >= 65 THEN 'good' WHEN score >= 45 THEN 'medium' ELSE 'retention_hole' END AS label FROM cbuckets"""),
    "clip_removed": _with(_TO_ALL, "SELECT * FROM cremoved"),
    "clip_cuts": _with(
        f"""{_TO_CLIPS},
        given AS (SELECT c.video_id, c.cand_idx, coalesce(p.seg_pos, 0) AS seg_pos, coalesce(p.start, c.start) AS s, coalesce(p."end", c."end") AS e, p.seg_pos IS NULL AS whole FROM clips c LEFT JOIN cpieces p ON p.video_id = c.video_id AND p.cand_idx = c.cand_idx)""",
        f"SELECT {_C}, (row_number() OVER (PARTITION BY {_C} ORDER BY seg_pos))::int AS n, s AS start, round_even(e - s, 4) AS duration, count(*) OVER (PARTITION BY {_C}) = 1 AS continuous FROM given WHERE (NOT whole AND e - s >= 0.05::double) OR (whole AND e > s)",
    ),
    "clip_rejects": _with(f"{_TO_CLIPS},{_VALID}", f"SELECT {_C}, clip_idx FROM clips WHERE cand_idx % 2 = 0 OR (video_id, cand_idx) NOT IN (SELECT (video_id, cand_idx) FROM cuts)"),
    "clip_records": _with(
        f"""{_TO_ALL},
        segs AS (SELECT {_C}, count(*) AS n, {_told("printf('%.3f', start)", "printf('%.3f', \"end\")", "role", "reason", order="seg_pos")} FROM (FROM cpieces UNION ALL BY NAME SELECT {_C}, 0 AS seg_pos, start, "end", 'escalation' AS role, 'retention_error' AS reason FROM clips WHERE strategy <> 'extractive') GROUP BY {_C}),
        tl AS (SELECT {_C}, count(*) AS n, {_told(*(f"printf('%.3f', {c}::double)" for c in ("index", "source_start", "source_end", "target_start", "target_end")), "role", order="index")} FROM (FROM cline UNION ALL BY NAME SELECT {_C}, 0 AS index, start AS source_start, "end" AS source_end, 0.0::double AS target_start, duration AS target_end, 'escalation' AS role FROM clips WHERE strategy <> 'extractive') GROUP BY {_C}),
        hv AS (SELECT {_C}, count(*) AS n, {_told("printf('%.3f', hook_pos::double)", "text", "type", "language", "printf('%.3f', n_evidence::double)", "printf('%.3f', score::double)", "printf('%.3f', source_start)", "printf('%.3f', source_end)", "application", order="hook_pos")} FROM hooks GROUP BY {_C}),
        bk AS (SELECT {_C}, count(*) AS n, {_told("printf('%.3f', round_even(start, 3))", "printf('%.3f', round_even(\"end\", 3))", "printf('%.3f', score::double)", "CASE WHEN score >= 80 THEN 'very_good' WHEN score >= 65 THEN 'good' WHEN score >= 45 THEN 'medium' ELSE 'retention_hole' END", order="bucket")} FROM cbuckets GROUP BY {_C}),
        rm AS (SELECT {_C}, count(*) AS n, {_told("printf('%.3f', start)", "printf('%.3f', \"end\")", "reason", order="start")} FROM cremoved GROUP BY {_C}),
        its AS (SELECT {_C}, kind, count(*) AS n, {_told(*(f"printf('%.3f', {c}::double)" for c in ("pos", "index", "start", '"end"', "source_start", "source_end", "weight")), "type", "reason", "text", order="pos, index")} FROM citems GROUP BY {_C}, kind)""",
        f"""SELECT {_C}, clip_idx, 'Window ' || window_idx AS title, 'why' AS reason, c.score, hb.text AS hook_text, hb.score AS hook_score, hb.n_evidence AS hook_evidence, ho.text AS voice_text,
        {", ".join(f"coalesce({t}.n, 0) AS n_{name}, coalesce({t}.told, md5('')) AS {name}_md5" for t, name in (("segs", "segments"), ("tl", "timeline"), ("hv", "hook_variants"), ("bk", "retention_timeline"), ("rm", "removed_segments"), *((k, k) for k in _ITEM_KINDS)))}
        FROM clips c LEFT JOIN hbest hb USING ({_C}) LEFT JOIN hvoice ho USING ({_C}) LEFT JOIN segs USING ({_C}) LEFT JOIN tl USING ({_C}) LEFT JOIN hv USING ({_C}) LEFT JOIN bk USING ({_C}) LEFT JOIN rm USING ({_C}) {" ".join(f"LEFT JOIN (SELECT * FROM its WHERE kind = '{k}') {k} USING ({_C})" for k in _ITEM_KINDS)}""",
    ),
    "hook_evidence": _with(f"{_TO_GOOD},{_HOOKS}", f"""SELECT {_C}, hook_pos, pos, cs0 + hook_pos AS start, cs0 + hook_pos + 1.5::double + pos AS "end", 'said at ' || pos AS reason FROM (SELECT *, unnest(range(0, n_evidence))::int AS pos FROM hooks)"""),
    "run_summary": _with(
        f"{_TO_ALL},{_VALID},{_VOICES}",
        """SELECT video_id, windows, coalesce(candidates, 0) AS candidates, coalesce(skipped, 0) AS skipped, coalesce(nclips, 0) AS clips, coalesce(exported, 0) AS exported, coalesce(hooked, 0) AS hooks_applied FROM (SELECT video_id, count(DISTINCT window_idx) AS windows FROM links GROUP BY video_id)
        LEFT JOIN (SELECT video_id, count(*) AS candidates, count(*) FILTER (WHERE cand_idx >= 8) AS skipped FROM cands GROUP BY video_id) USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS nclips FROM clips GROUP BY video_id) USING (video_id) LEFT JOIN exports USING (video_id) LEFT JOIN (SELECT video_id, count(*) FILTER (WHERE applied) AS hooked FROM timed GROUP BY video_id) USING (video_id)""",
    ),
    "audit_records": _with(
        f"""{_TO_ALL},{_VOICES}, hn AS (SELECT {_C}, count(*) AS n FROM hooks GROUP BY {_C}), vn AS (SELECT {_C}, count(*) AS n, arg_max(retention_score, variant_pos) AS last_score FROM vfinal GROUP BY {_C}), sn AS (SELECT {_C}, count(*) AS n FROM cpieces GROUP BY {_C})""",
        f"""SELECT {_C}, CASE WHEN ok THEN NULL ELSE 'no JSON object' END AS error, c.window_idx, c.score, c.content_type, CASE WHEN ok THEN CASE WHEN video_id % 4 = 0 THEN 'tts' ELSE 'extractive' END END AS second_strategy, CASE WHEN ok THEN 'because 1' END AS second_anchor,
        CASE WHEN ok THEN round_even(xs, 3) END AS context_start, CASE WHEN ok THEN round_even(xe, 3) END AS context_end, CASE WHEN ok THEN word_count END AS word_count, hn.n AS n_hooks, vn.n AS n_variants, vn.last_score, c.clip_idx, c.retention_score, coalesce(sn.n, 1) AS n_segments,
        t.applied, CASE WHEN t.text IS NULL AND NOT t.applied THEN 'no_valid_generated_hook' WHEN failed AND t.text IS NOT NULL THEN 'synthesis failed' END AS reason, CASE WHEN t.applied THEN t.text END AS spoken
        FROM (SELECT *, strategy = 'extractive' AS ok FROM clips) c JOIN ctx USING ({_C}) LEFT JOIN pace USING ({_C}) LEFT JOIN hn USING ({_C}) LEFT JOIN vn USING ({_C}) LEFT JOIN sn USING ({_C}) LEFT JOIN (SELECT {_C}, applied, failed, text FROM timed) t USING ({_C})""",
    ),
    "catalogue_clips": _with(
        f"""{_TO_ALL},{_VOICES}, sn AS (SELECT {_C}, count(*) AS n FROM cpieces GROUP BY {_C}), tl AS (SELECT {_C}, arg_max(target_end, index) AS t FROM cline GROUP BY {_C})""",
        f"""SELECT {_C}, c.clip_idx, c.score, retention_score, start, "end", coalesce(sn.n, 1) AS n_segments, CASE WHEN strategy = 'extractive' THEN tl.t ELSE c.duration END AS last_target, t.applied, CASE WHEN t.text IS NULL AND NOT t.applied THEN 'no_valid_generated_hook' WHEN failed AND t.text IS NOT NULL THEN 'synthesis failed' END AS reason, CASE WHEN t.applied THEN t.text END AS spoken
        FROM clips c LEFT JOIN sn USING ({_C}) LEFT JOIN tl USING ({_C}) LEFT JOIN (SELECT {_C}, applied, failed, text FROM timed) t USING ({_C})""",
    ),
    "catalogue_audit": _with(
        f"""{_TO_ALL},{_VOICES}, hn AS (SELECT {_C}, count(*) AS n FROM hooks GROUP BY {_C})""",
        f"""SELECT {_C}, b.score AS backup_score, CASE WHEN strategy <> 'extractive' THEN 'no JSON object' END AS error, hn.n AS n_hooks, content_type, t.applied, CASE WHEN t.applied THEN t.text END AS spoken
        FROM cands b LEFT JOIN clips c USING ({_C}) LEFT JOIN hn USING ({_C}) LEFT JOIN (SELECT {_C}, applied, text FROM timed) t USING ({_C})""",
    ),
    "voice_hooks_spoken": _with(f"{_TO_ALL}", f"SELECT video_id, clip_idx, text, type, h.score, language FROM clips c JOIN hvoice h USING ({_C})"),
    "voice_records": _with(
        f"{_TO_ALL},{_VOICES}",
        f"""SELECT video_id, clip_idx, applied, CASE WHEN text IS NULL THEN 'no_valid_generated_hook' WHEN failed THEN 'synthesis failed' END AS reason, CASE WHEN applied THEN text END AS text, CASE WHEN applied THEN type END AS type, CASE WHEN applied THEN score END AS hook_score, CASE WHEN applied THEN language END AS language, CASE WHEN applied THEN round_even(fit, 3) END AS hook_duration,
        CASE WHEN applied THEN '{fixed.VOICE_PROVIDER}' END AS provider, CASE WHEN applied THEN '{fixed.VOICES[fixed.VOICE_CODES["en"]]}' END AS voice, n_timings, last_word, last_start, CASE WHEN applied THEN round_even(ts, 3) END AS teaser_start, CASE WHEN applied THEN round_even(least(duration, ts + hd), 3) END AS teaser_end, CASE WHEN applied THEN CASE WHEN a IS NULL THEN 'clip_start' ELSE 'retention_anchor' END END AS teaser_source, CASE WHEN applied THEN round_even(fit, 3) END AS audio_start
        FROM teased LEFT JOIN wlast USING (video_id, clip_idx)""",
    ),
    "voice_missing": _with(_TO_CLIPS, "SELECT video_id, clip_idx FROM clips WHERE (video_id + clip_idx) % 9 = 0"),
    "voice_mix": _with(
        f"""{_TO_BEST},
        m_items AS (SELECT video_id, cand_idx, max({{'i': ((video_id * 7 + h * 31) % 101)::double, 'p': -h, 's': ((h * 9 + video_id) % 40)::double, 'e': ((h * 9 + video_id) % 40 + 3)::double}}) AS a FROM best, (SELECT unnest(range(0, 5))::int AS h) GROUP BY ALL),
        m_clips AS (SELECT b.video_id, b.cand_idx, b."end" - b.start AS duration, 1.0::double + b.video_id % 25 / 10.0::double AS hook_duration, a FROM best b JOIN m_items USING ({_C})),
        m_hook AS (SELECT *, least(greatest(0.1::double, hook_duration), greatest(0.1::double, duration)) AS hd FROM m_clips),
        m_start AS (SELECT *, greatest(0.0::double, least(greatest(0.0::double, duration - hd), greatest(a.s, (a.s + a.e) / 2.0::double) - hd / 2.0::double)) AS teaser_start FROM m_hook),
        m_end AS (SELECT *, least(duration, teaser_start + hd) AS teaser_end, CASE WHEN hook_duration * 3 <= {fixed.VOICE_SECONDS + 0.02!r}::double THEN 1.0::double ELSE hook_duration * 3 / {fixed.VOICE_SECONDS!r}::double END AS speed FROM m_start),
        m_all AS (SELECT *, greatest(0.0::double, least(duration, teaser_start)) AS s, greatest(0, ceil(log2(speed)) - 1)::int AS twos, least({fixed.VOICE_FADE!r}::double, hook_duration / 3.0::double) AS fade FROM m_end)""",
        f"""SELECT {_C}, duration, hook_duration, teaser_start, teaser_end, 'retention_anchor' AS teaser_source, greatest(0.0::double, hook_duration - greatest(0.01::double, greatest(s + 0.01::double, least(duration, teaser_end)) - s)) AS pad, fade, greatest(0.0::double, hook_duration - fade) AS fade_start, speed,
        array_to_string(list_concat(list_transform(range(0, twos), lambda q: '2.000000'), [printf('%.6f', speed / 2 ** twos)]), ',') AS tempo FROM m_all""",
    ),
    "voice_routes": _with(
        _BASE,
        f"""SELECT v.video_id, v.language, k.code AS lang_code, CASE WHEN k.code IS NULL THEN '{fixed.VOICE_FALLBACK}' ELSE '{fixed.VOICE_PROVIDER}' END AS provider, CASE WHEN k.code IS NULL THEN '' WHEN v.video_id % 3 = 0 THEN 'own_voice' ELSE n.voice END AS voice
        FROM (SELECT DISTINCT video_id, {_case(["en", "EN-GB ", "ro", "auto", "", "pt_br", "zh", "xx"], "video_id % 8 + 1")} AS language FROM segments) v
        LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in fixed.VOICE_CODES.items())}) k(given, code) ON k.given = CASE WHEN lower(trim(v.language)) IN ('', 'auto') THEN '{fixed.VOICE_LANGUAGE}' ELSE lower(trim(v.language)) END
        LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in fixed.VOICES.items())}) n(code, voice) ON n.code = k.code""",
    ),
    "caption_styles": _with(
        _BASE,
        f"""SELECT v.*, t.* EXCLUDE (style) FROM (SELECT DISTINCT video_id, {_case(["modern", "tiktok", "reels", "capcut", "submagic", "minimal", "tiktok"], "video_id % 7 + 1")} AS style FROM segments) v
        JOIN (VALUES {", ".join("('" + "', '".join([name, *(str((fixed.STYLE_BASE | own)[f]) for f in fixed.STYLE_FIELDS)]) + "')" for name, own in fixed.STYLES.items())}) t(style, {", ".join(fixed.STYLE_FIELDS)}) ON t.style = v.style""",
    ),
    "scalar_functions": _with(
        rf"""{_BASE},
        c AS (SELECT *, regexp_replace(regexp_replace(lower(trim(word)), '^[\s"“”„''()\[\]{{}}]+', ''), '[\s"“”„''()\[\]{{}}.,!?;:]+$', '') AS ct, start * 10 AS t FROM words),
        h AS (SELECT *, floor(greatest(0.0::double, t)) AS w, round_even((greatest(0.0::double, t) - floor(greatest(0.0::double, t))) * 100, 0)::bigint AS hh FROM c),
        k AS (SELECT *, (w + CASE WHEN hh >= 100 THEN 1 ELSE 0 END)::bigint AS carried FROM h)""",
        r"""SELECT video_id, seg_idx, word_idx, regexp_replace(lower(trim(word)), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS pacing_token, ct AS caption_token, regexp_matches(replace(ct, ',', '.'), '^\d+(\.\d+)?%?$') AS is_number, regexp_matches(word, '[.!?]["'']?$') AS ends_sentence, regexp_matches(word, '[,;:]\s*$') AS ends_clause,
        regexp_replace(word, '[.,!?;:"''(){}\[\]]', '', 'g') AS bare, regexp_matches(word, '^[.,!?;:]+$') AS is_punctuation, (carried // 3600) || ':' || lpad((carried % 3600 // 60)::varchar, 2, '0') || ':' || lpad((carried % 60)::varchar, 2, '0') || '.' || lpad(CASE WHEN hh >= 100 THEN 0 ELSE hh END::varchar, 2, '0') AS clock FROM k""",
    ),
    "boundary_costs": _with(f"{_TO_WINDOWS},{_WINDOW_WORDS},{_ideas(_W)},{_costs(_W)}", "SELECT * FROM breaks"),
    "caption_groups": _with(f"{_TO_WINDOWS},{_WINDOW_WORDS},{_ideas(_W)},{_costs(_W)},{_groups(_W)}", f"""SELECT {_W}, group_idx, ws[1].s AS start, ws[-1].e AS "end", array_to_string(list_transform(ws, lambda x: x.w), ' ') AS text FROM captions"""),
    "caption_events": _with(f"{_TO_WINDOWS},{_WINDOW_WORDS},{_ideas(_W)},{_costs(_W)},{_groups(_W)},{_events(_W)}", 'SELECT * FROM events WHERE "end" > start'),
    "clip_subtitles": _with(
        f"{_TO_ALL},{_VOICES},{_CLIP_WORDS},{_ideas(_P)},{_costs(_P)},{_groups(_P)},{_events(_P)}",
        f"""SELECT video_id, clip_idx, length(document)::bigint AS n_chars, md5(document) AS document_md5 FROM (SELECT video_id, clip_idx, '{_HEAD}' || string_agg('Dialogue: 0,' || {_clock("start")} || ',' || {_clock('"end"')} || ',Default,,0,0,0,,{fixed.LINE_TAGS["capcut"]}' || text, chr(10) ORDER BY part, group_idx, active_index) || chr(10) AS document FROM events WHERE "end" > start GROUP BY video_id, clip_idx)""",
    ),
    "crop_points": _with(f"{_TO_BEST},{_CROP}", "SELECT * FROM corners"),
    "crop_commands": _with(
        f"""{_TO_BEST},{_CROP},
        steps AS (SELECT *, lead(time) OVER o AS nt, lead(x) OVER o AS nx, lead(y) OVER o AS ny, count(*) OVER (PARTITION BY video_id, clip_idx) AS every FROM corners WINDOW o AS (PARTITION BY video_id, clip_idx ORDER BY n)),
        commands AS (SELECT *, printf('%.3f-%.3f', round_even(time, 3), round_even(greatest(nt, time + 0.001::double), 3)) AS span FROM steps),
        texts AS (SELECT video_id, clip_idx, string_agg(CASE WHEN every = 1 THEN printf('0.000 crop@smart x %.3f;', round_even(x, 3)) || chr(10) || printf('0.000 crop@smart y %.3f;', round_even(y, 3)) ELSE span || printf(' [expr] crop@smart x ''lerp(%.3f,%.3f,TI)'';', round_even(x, 3), round_even(nx, 3)) || chr(10) || span || printf(' [expr] crop@smart y ''lerp(%.3f,%.3f,TI)'';', round_even(y, 3), round_even(ny, 3)) END, chr(10) ORDER BY n) || chr(10) AS document FROM commands WHERE every = 1 OR nt IS NOT NULL GROUP BY ALL)""",
        "SELECT video_id, clip_idx, length(document)::bigint AS n_chars, md5(document) AS document_md5 FROM texts",
    ),
    "long_segments": _long(_BASE, 'SELECT video_id, seg_idx, start, "end", md5(text) AS text_md5 FROM segments'),
    "long_windows": _long(_TO_WINDOWS, "SELECT video_id, window_idx, window_start, window_end, seg_idx FROM links"),
    "long_pacing": _long(_TO_PACE, "SELECT * FROM pace"),
    "long_candidates": _long(_TO_BEST, "SELECT *, cand_idx < 8 AS edited FROM cands"),
    "long_summary": _long(
        f"{_TO_CLIPS},{_VALID}",
        """SELECT video_id, windows, coalesce(candidates, 0) AS candidates, coalesce(skipped, 0) AS skipped, coalesce(edited, 0) AS clips, coalesce(exported, 0) AS exported FROM (SELECT video_id, count(DISTINCT window_idx) AS windows FROM links GROUP BY video_id)
        LEFT JOIN (SELECT video_id, count(*) AS candidates, count(*) FILTER (WHERE cand_idx >= 8) AS skipped, count(*) FILTER (WHERE cand_idx < 8) AS edited FROM cands GROUP BY video_id) USING (video_id) LEFT JOIN exports USING (video_id)""",
    ),
}
#: The written subtitles are those of the job in memory.
SQL["catalogue_documents"] = SQL["clip_subtitles"]
#: The second catalogue's contexts, with a limit that is passed.
SQL["long_context_text"] = SQL["context_text"].replace(_TURNS, _LINES).replace(str(fixed.CONTEXT_CHARS), "2500")
