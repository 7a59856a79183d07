"""SQL for the queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM bw WHERE len(w) > 0) t),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM win) l WHERE len(w) >= n) t),
hit AS (SELECT doc_id, item, i, n FROM pos JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hit) t GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) t GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM dw) t),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
df AS (SELECT s, count(*) AS d FROM sh GROUP BY s),
pre AS (SELECT doc_id, s, n FROM (SELECT sh.doc_id, s, n, row_number() OVER (PARTITION BY sh.doc_id ORDER BY d, s) AS r FROM sh JOIN df USING (s) JOIN n USING (doc_id)) t WHERE r <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b USING (s) WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
link AS (SELECT a, b FROM (SELECT a, b, na, nb, count(*) AS common FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, na, nb) t WHERE 100 * common >= 80 * (na + nb - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT edge.b AS v, reach.c FROM reach JOIN edge ON edge.a = reach.v WHERE reach.c < edge.b)
SELECT dw.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, dw.doc_id) AS component_id, coalesce(c, dw.doc_id) = dw.doc_id AS kept
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN (SELECT v, min(c) AS c FROM reach GROUP BY v) m ON m.v = dw.doc_id
"""


LEVELS = 8


def url_filter() -> str:
    """The same tree as the operator's, level by level; paths of the tables it is run on have no more than LEVELS."""
    from tidemark.llm.url_filter import DOUBT, LEAST, PRIOR, REJECT, RULES, Z

    kind = "CASE WHEN {s} IS NULL THEN '-' WHEN regexp_matches({s}, '^[0-9]+$') THEN 'n' WHEN regexp_matches({s}, '^[^0-9]+$') THEN 'w' ELSE 'x' END"
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    name = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules) + " END"
    out = [
        r"base AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        "known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id)",
        "t0 AS (SELECT host, path, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, host AS template FROM base LEFT JOIN known USING (page_id) GROUP BY host, path)",
    ]
    for d in range(LEVELS):
        seg = f"segs[{d + 1}]"
        out += [
            f"c{d} AS (SELECT template, {seg} AS seg, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad, array_to_string(list_sort(list(DISTINCT {kind.format(s=f'segs[{d + 2}]')})), '') AS make FROM t{d} WHERE {seg} IS NOT NULL GROUP BY 1, 2)",
            f"l{d} AS (SELECT template, seg, n, labelled, bad, make || ':' || CAST(CAST(floor(4 * (bad + 0.5) / (labelled + 1)) AS BIGINT) AS VARCHAR) AS make FROM c{d} WHERE n >= {LEAST})",
            f"j{d} AS (SELECT *, abs(bad - rate * labelled) <= {Z} * sqrt(labelled * rate * (1 - rate)) AS alike FROM (SELECT *, CAST(sum(bad) OVER w AS DOUBLE) / greatest(sum(labelled) OVER w, 1) AS rate FROM l{d} WINDOW w AS (PARTITION BY template, make)) z)",
            f"m{d} AS (SELECT template, make, min(seg) AS first, count(*) AS k FROM j{d} WHERE alike GROUP BY template, make)",
            f"n{d} AS (SELECT j{d}.template, seg, CASE WHEN alike AND k > 1 THEN '{{' || first || ':' || j{d}.make || '}}' ELSE seg END AS name FROM j{d} LEFT JOIN m{d} ON m{d}.template = j{d}.template AND m{d}.make = j{d}.make)",
            f"t{d + 1} AS (SELECT host, path, n, labelled, bad, segs, t{d}.template || CASE WHEN {seg} IS NULL THEN '' ELSE '/' || coalesce(name, '*') END AS template FROM t{d} LEFT JOIN n{d} ON n{d}.template = t{d}.template AND n{d}.seg = {seg})",
        ]
    out += [
        f"tree AS (SELECT host, path, labelled, bad, template FROM t{LEVELS})",
        f"leaf AS (SELECT template, sum(labelled) > 0 AND (sum(bad) + {PRIOR} * (SELECT sum(bad) / (sum(labelled) + {DOUBT}) FROM tree)) / (sum(labelled) + {PRIOR}) >= {REJECT} AS rejected FROM tree GROUP BY template)",
    ]
    return f"WITH {', '.join(out)} SELECT page_id, host, path, {name} AS rule, coalesce({verdict}, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template FROM base JOIN tree USING (host, path) JOIN leaf USING (template)"
