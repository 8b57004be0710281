"""SQL of the text operators that SQL can express on whole tables, for DuckDB."""

from .clustering import SCALE, Settings
from .quality import STEPS, RiskControl

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str) -> str:
    """key, i, w, n: the words of each text with their places from 1."""
    return f"SELECT {key}, generate_subscripts(ws, 1) AS i, unnest(ws) AS w, len(ws) AS n FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM {table}) t"


def _grams(source: str, key: str) -> str:
    """Each word with a list of it and the nine after it."""
    leads = ", ".join(["w", *(f"lead(w, {k}) OVER (PARTITION BY {key} ORDER BY i)" for k in range(1, 10))])
    return f"SELECT {key}, i, n, [{leads}] AS g FROM {source}"


DECONTAMINATION = f"""
WITH dw AS ({_words("documents", "doc_id")}), iw AS ({_words("benchmark", "item_id")}),
dg AS ({_grams("dw", "doc_id")}), ig AS ({_grams("iw", "item_id")}),
pat AS (SELECT DISTINCT item_id, least(10, n) AS m, array_to_string(g[1:least(10, n)], ' ') AS s FROM ig WHERE i + least(10, n) - 1 <= n),
occ AS (SELECT d.doc_id AS doc_id, d.i AS i, p.m AS m, p.item_id AS item_id FROM (SELECT doc_id, i, k.m AS m, array_to_string(g[1:k.m], ' ') AS s FROM dg, (SELECT DISTINCT m FROM pat) k WHERE i + k.m - 1 <= n) d JOIN pat p ON p.m = d.m AND p.s = d.s),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, i, m FROM occ) o) u GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) o GROUP BY doc_id),
size AS (SELECT doc_id, max(n) AS n FROM dw GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(s.n, 0) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items, sha256(coalesce(o.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN own o ON o.doc_id = d.doc_id
"""

LINE_DEDUP = rf"""
WITH li AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM li),
hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, hot.key IS NOT NULL AND k.doc_id <> hot.last AS gone FROM k LEFT JOIN hot ON hot.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""


def quality_rules(control: RiskControl = RiskControl()) -> str:
    """The measures, the exact binomial tests over labels and the verdict."""
    gram = "concat_ws(' ', w, " + ", ".join(f"lead(w, {k}) OVER o" for k in range(1, 5)) + ")"
    measures = {"symbols_per_word": "n_symbols / greatest(n_words, 1.0)", "duplicate_lines": "n_dup_lines / greatest(n_word_lines, 1.0)", "long_words": "word_chars / greatest(n_words, 1.0)", "short_words": "-word_chars / greatest(n_words, 1.0)"}
    first = "CASE " + " ".join(f"WHEN {measures[rule]} > CAST({c!r} AS DOUBLE) THEN {i}" for i, (rule, c) in enumerate(STEPS)) + f" ELSE {len(STEPS)} END"
    share, steps = repr(control.share), len(STEPS)
    return rf"""
WITH dw AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents) t),
g AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN {gram} END AS s FROM dw WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g WHERE s IS NOT NULL) t WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM again) t GROUP BY doc_id),
li AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) t WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
ws AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars FROM dw GROUP BY doc_id),
m AS (SELECT d.doc_id AS doc_id, d.lang AS lang, coalesce(ws.n, 0) AS n_words, CAST(coalesce(ws.chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(li.dup, 0) AS n_dup_lines, coalesce(li.lines, 0) AS n_word_lines, coalesce(cov.n, 0) AS n_repeat_words FROM documents d LEFT JOIN ws ON ws.doc_id = d.doc_id LEFT JOIN li ON li.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
v AS (SELECT *, {first} AS step FROM b),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT lang, doc_id, min(step) AS step FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY lang, doc_id),
cells AS (SELECT held.lang AS lang, r.i AS i, count(*) AS n, count(*) FILTER (WHERE held.step <= r.i) AS k FROM held, (SELECT unnest(range(0, {steps})) AS i) r GROUP BY held.lang, r.i),
tails AS (SELECT lang, i, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share}))) AS p FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM cells WHERE k < n * {share}) t GROUP BY lang, i),
safe AS (SELECT c.lang AS lang, coalesce(min(c.i) FILTER (WHERE coalesce(t.p, 1) > {control.error!r} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM cells) u)), {steps}) AS steps FROM cells c LEFT JOIN tails t ON t.lang IS NOT DISTINCT FROM c.lang AND t.i = c.i GROUP BY c.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND step >= coalesce(safe.steps, 0) AS kept FROM v LEFT JOIN safe ON safe.lang IS NOT DISTINCT FROM v.lang
"""


EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def _crc32(text: str) -> str:
    """The CRC-32 of a text of code points below 256, by half bytes."""
    halves = list(range(16))
    for _ in range(4):
        halves = [x >> 1 ^ (x & 1) * 0xEDB88320 for x in halves]
    table = "[" + ", ".join(map(str, halves)) + "]::BIGINT[]"
    utf8 = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c) & 15, unicode(c) >> 4] ELSE [(192 + (unicode(c) >> 6)) & 15, 12, (unicode(c) & 63) & 15, 8 + ((unicode(c) & 63) >> 4)] END))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {utf8}::BIGINT[]), lambda c, x: xor(c >> 4, ({table})[(xor(c, x) & 15) + 1])), 4294967295::BIGINT)"


SPELLING = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) t WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed) t WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, length(word) AS m, i, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w) t),
pairs AS (SELECT x.word AS u, y.word AS v FROM cut x JOIN cut y ON x.m = y.m AND x.i = y.i AND x.a = y.a AND x.b = y.b WHERE x.word <> y.word UNION SELECT c.word, w.word FROM cut c JOIN w ON w.word = c.a || c.b UNION SELECT w.word, c.word FROM cut c JOIN w ON w.word = c.a || c.b),
best AS (SELECT u, count(*) AS n_near, max(w.n) AS top FROM pairs JOIN w ON w.word = v GROUP BY u),
formed AS (SELECT w.word AS word, w.n AS n, coalesce(best.n_near, 0) AS n_near, CASE WHEN best.top >= 2 * w.n THEN best.top END AS form_n FROM w LEFT JOIN best ON best.u = w.word),
form AS (SELECT f.word AS word, min(x.word) AS form FROM formed f JOIN pairs p ON p.u = f.word JOIN w x ON x.word = p.v AND x.n = f.form_n GROUP BY f.word),
walk AS (SELECT word, word AS place, 0 AS steps FROM w UNION ALL SELECT walk.word, form.form, steps + 1 FROM walk JOIN form ON form.word = walk.place),
ends AS (SELECT word, arg_max(place, steps) AS root FROM walk GROUP BY word)
SELECT f.word AS word, form.form AS form, ends.root AS root, f.n AS n, f.n_near AS n_near, f.form_n AS form_n FROM formed f JOIN ends ON ends.word = f.word LEFT JOIN form ON form.word = f.word
"""


def clustering(settings: Settings = Settings()) -> str:
    """Every vector against every centroid, round by round."""
    floor_mean = "(s - ((s % n) + n) % n) // n"
    steps = []
    for k in range(settings.rounds + 1):
        steps.append(f"a{k} AS (SELECT row, vec_id, v, unnest(list_sort(list((d, c)))[1:1]) AS best FROM (SELECT row, vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM vec, c{k}) t GROUP BY row, vec_id, v)")
        if k < settings.rounds:
            steps.append(f"m{k} AS (SELECT c, list({floor_mean} ORDER BY j) AS cv FROM (SELECT best[2] AS c, j, CAST(sum(v[j]) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n FROM a{k}, (SELECT unnest(range(1, {settings.components + 1})) AS j) t GROUP BY best[2], j) t GROUP BY c)")
            steps.append(f"c{k + 1} AS (SELECT o.c AS c, coalesce(m{k}.cv, o.cv) AS cv FROM c{k} o LEFT JOIN m{k} ON m{k}.c = o.c)")
    last = settings.rounds
    return f"""
WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {settings.components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {settings.components}),
vec AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS cv FROM (SELECT sha256('{settings.draw}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM vec WHERE vec_id IS NOT NULL) t ORDER BY h, v LIMIT {settings.centroids}),
{", ".join(steps)},
own AS (SELECT best[2] AS c, CAST(sum(best[1]) AS BIGINT) AS cluster_inertia FROM a{last} GROUP BY best[2])
SELECT a.vec_id AS vec_id, CAST(a.best[2] AS INT) AS cluster, a.best[1] AS distance, own.cluster_inertia AS cluster_inertia, (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM own) AS inertia, sha256(array_to_string(f.cv, ',')) AS centroid_sha256
FROM a{last} a JOIN own ON own.c = a.best[2] JOIN c{last} f ON f.c = a.best[2]
"""
