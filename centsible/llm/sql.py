"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from centsible.llm.secrets import BASE_RULES, MORE_RULES

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _secret_spans() -> str:
    """Matches of every rule, with their places by running sums of what lies between them."""
    selects = []
    for order, rule in enumerate(BASE_RULES + MORE_RULES):
        pattern = rule.pattern.replace("'", "''")
        selects.append(
            f"""SELECT doc_id, kind, number, after - whole AS first, after AS last FROM (
            SELECT doc_id, '{rule.kind}' AS kind, {order} AS number, whole, judged,
                sum(gap + whole) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM (
            SELECT doc_id, i, length(gaps[i]) AS gap, length(wholes[i]) AS whole, length(parts[i]) AS judged FROM (
            SELECT doc_id, gaps, wholes, parts, unnest(range(1, len(wholes) + 1)) AS i FROM (
            SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS wholes,
                regexp_extract_all(text, '{pattern}', {rule.group}) AS parts FROM documents))))
            WHERE judged >= {rule.least}"""
        )
    return " UNION ALL ".join(selects)


def _listed(where: str = "") -> str:
    spans = "concat(kind, ':', CAST(first AS BIGINT), ':', CAST(last AS BIGINT))"
    return f"coalesce(string_agg({spans}, ',' ORDER BY first, number){where}, '')"


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, wide: int = 16) -> str:
    """Plain Lloyd rounds: every part beside every entry, every time."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS n, vec_id, label,
            list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT n, p, v[p * {wide} + 1 : (p + 1) * {wide}] AS x
            FROM kept, (SELECT unnest(range({parts})) AS p))""",
        f"book0 AS MATERIALIZED (SELECT p, n AS k, x AS c FROM parts WHERE n < {entries})",
    ]
    for turn in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(
            f"""near{turn} AS MATERIALIZED (SELECT n, p, min(struct_pack(e := {apart}, k := k)) AS best
            FROM parts JOIN book{turn} USING (p) GROUP BY n, p)"""
        )
        if turn < rounds:
            steps.append(
                f"""sums{turn} AS MATERIALIZED (SELECT p, k, i, CAST(sum(y) AS HUGEINT) AS s, count(*) AS m FROM (
                SELECT p, best.k AS k, unnest(x) AS y, unnest(range(len(x))) AS i
                FROM near{turn} JOIN parts USING (n, p)) GROUP BY p, k, i)"""
            )
            steps.append(
                f"""book{turn + 1} AS MATERIALIZED (SELECT p, k, coalesce(moved, c) AS c FROM book{turn} LEFT JOIN (
                SELECT p, k, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS moved FROM sums{turn} GROUP BY p, k)
                USING (p, k))"""
            )
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT n, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.e) AS BIGINT) AS error
            FROM near{rounds} GROUP BY n),
        books AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, i)) AS digest FROM (
            SELECT p, k, unnest(c) AS y, unnest(range(len(c))) AS i FROM book{rounds}))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            digest AS codebooks_sha256 FROM kept JOIN coded USING (n), books"""


def _spelling() -> str:
    """Near words by equal deletions at equal places, or by a deletion that equals a word."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(str(value))
    step = "xor(crcs[(xor(c, b) & 255) + 1], c >> 8)"
    return f"""WITH RECURSIVE crc AS (SELECT [{", ".join(table)}]::BIGINT[] AS crcs),
        runs AS (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id,
            unnest(regexp_extract_all({LOWER}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS word FROM documents) GROUP BY ALL),
        hexed AS (SELECT word, k, hex(concat(doc_id, ':', word)) AS digits FROM runs),
        checked AS (SELECT word, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(digits) // 2),
            lambda i: CAST((instr('0123456789ABCDEF', digits[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1 AS BIGINT))),
            lambda c, b: {step})) AS h FROM hexed, crc),
        slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, CAST(h % length(word) AS BIGINT)) ||
            substr(word, CAST(h % length(word) AS BIGINT) + 2) ELSE word END AS word, k FROM checked),
        words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        cuts AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS MATERIALIZED (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word),
        best AS (SELECT p.word, count(*) AS n_near, min(struct_pack(m := -w.n, form := p.other)) AS b
            FROM pairs p JOIN words w ON p.other = w.word GROUP BY p.word),
        forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * w.n THEN b.form END AS form,
            CASE WHEN -b.m >= 2 * w.n THEN -b.m END AS form_n FROM words w LEFT JOIN best USING (word)),
        chain AS (SELECT word, word AS root, form AS next FROM forms
            UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)"""


_BASE = ", ".join(f"'{rule.kind}'" for rule in BASE_RULES)

SQL = {
    "op1_ngram_join": f"""
        WITH RECURSIVE worded AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\\x09-\\x0D\\x20]+'),
            lambda w: w <> '') AS words FROM documents),
        sets AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (
            SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM worded)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        links AS (SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) c
            JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b WHERE 100 * common >= 80 * (p.n + q.n - common)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
        SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(other) AS component_id
        FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op2_decontaminate": f"""
        WITH worded AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
        phrases AS (SELECT DISTINCT item, size, array_to_string(words[i:i + size - 1], ' ') AS phrase FROM (
            SELECT item, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM (
                SELECT *, least(len(words), 13) AS size FROM items WHERE len(words) > 0))),
        windows AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS phrase FROM (
            SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
            FROM worded, (SELECT DISTINCT size FROM phrases) WHERE len(words) >= size)),
        hits AS (SELECT w.doc_id, w.i, w.size, p.item FROM windows w JOIN phrases p ON w.size = p.size AND w.phrase = p.phrase),
        covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(d.words), 0) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
            sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= coalesce(len(d.words), 0) AS contaminated
        FROM worded d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id""",
    "op10_secret_scan": f"""
        WITH found AS ({_secret_spans()}),
        listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex, {_listed(f" FILTER (kind IN ({_BASE}))")} AS base, {_listed()} AS spans FROM found GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id""",
    # document, line and earliest equal or near line; words as lists, a line's class as its words joined
    "op7_line_dedup": """
        WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
        every AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS line FROM split),
        worded AS (SELECT doc_id, line, list_filter(regexp_split_to_array(
            translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'),
            lambda w: w <> '') AS words FROM every),
        lines AS (SELECT doc_id, line, len(words) AS n, array_to_string(words, ' ') AS class, words FROM worded WHERE len(words) > 0),
        placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS place FROM lines),
        firsts AS (SELECT class, min(place) AS place, any_value(words) AS words, any_value(n) AS n FROM placed GROUP BY class),
        gaps AS (SELECT place, class, words, n, unnest(range(1, n + 1)) AS gap FROM firsts WHERE n >= 2),
        cut AS (SELECT place, class, n, gap, array_to_string(list_concat(words[1:gap - 1], words[gap + 1:]), ' ') AS rest FROM gaps),
        replaced AS (SELECT n, gap, rest, min(place) AS low FROM cut GROUP BY n, gap, rest HAVING count(*) > 1),
        pairs AS (
            SELECT c.place, r.low AS near FROM cut c JOIN replaced r ON c.n = r.n AND c.gap = r.gap AND c.rest = r.rest WHERE r.low < c.place
            UNION ALL SELECT greatest(c.place, f.place), least(c.place, f.place) FROM cut c JOIN firsts f ON c.rest = f.class AND f.n >= 2),
        near AS (SELECT place, min(near) AS near FROM pairs GROUP BY place),
        judged AS (SELECT p.doc_id, p.line, p.place <> f.place AS again, CASE WHEN p.place <> f.place THEN f.place ELSE e.near END AS target
            FROM placed p JOIN firsts f ON p.class = f.class LEFT JOIN near e ON e.place = f.place),
        dropped AS (SELECT j.doc_id, count(*) AS n_lines, count(j.target) AS n_dropped, string_agg(CASE WHEN j.target IS NOT NULL THEN
            concat(j.line, ':', t.doc_id, ':', t.line, ':', CASE WHEN j.again THEN 0 ELSE 1 END) END, ',' ORDER BY j.line) AS dropped
            FROM judged j LEFT JOIN placed t ON t.place = j.target GROUP BY j.doc_id)
        SELECT d.doc_id, CAST(coalesce(x.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n_dropped, 0) AS BIGINT) AS n_dropped,
            coalesce(x.dropped, '') AS dropped FROM documents d LEFT JOIN dropped x ON d.doc_id = x.doc_id""",
    "op9_url_filter": """
        WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
            ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        cut AS (SELECT row_number() OVER () AS n, page_id,
            CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT n, page_id, regexp_extract(rest, '^[^/?#]*') AS authority, rest FROM cut),
        urls AS (SELECT n, page_id, translate(authority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(substr(rest, length(authority) + 1), '^[^?#]*') AS path FROM parts),
        fits AS (SELECT u.n, u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
            row_number() OVER (PARTITION BY u.n ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
            FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1""",
    "op12_vector_codes": _vector_codes(),
    "op13_spelling": _spelling(),
}
