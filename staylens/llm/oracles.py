"""DuckDB texts of the queries that SQL can express, over the views of the given tables."""

from __future__ import annotations

from staylens.llm import licenses, mixing, url_filter


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def url_sql(rules=url_filter.RULES, order: int = url_filter.ORDER) -> str:
    u = url_filter
    rule, verdict = "NULL", "NULL"
    for said, pattern in sorted(rules, key=lambda r: len(r[1])):
        at = pattern.find("/")
        h, p = (pattern, "") if at < 0 else (pattern[:at], pattern[at:])
        fits = f"(host = {_text(h)} OR ends_with(host, {_text('.' + h)})) AND starts_with(path, {_text(p)})"
        rule, verdict = (f"CASE WHEN {fits} THEN {_text(x)} ELSE {old} END" for x, old in ((pattern, rule), (said, verdict)))
    ctes = [f"""parsed AS (SELECT page_id,
      translate(regexp_extract(coalesce(url, ''), '{u.URL_PATTERN}', 1), '{u.UPPER}', '{u.LOWER}') AS host,
      regexp_extract(coalesce(url, ''), '{u.URL_PATTERN}', 2) AS path FROM pages)""",
            f"""texts AS (SELECT *, ruled IS NOT NULL AND CAST('0x' || substr(md5(host || path), 1, 7) AS BIGINT) % {u.FOLDS} = 0 AS calibrates
      FROM (SELECT host, path, count(*) AS n, {rule} AS rule, {verdict} AS ruled FROM parsed GROUP BY host, path))""",
            f"""positions AS (SELECT *, substr(repeat(chr({ord(u.PAD)}), {order}) || host || path, i, {order + 1}) AS gram
      FROM (SELECT *, unnest(generate_series(1, length(host || path))) AS i FROM texts))""",
            """g AS (SELECT gram, sum(CASE WHEN NOT calibrates AND ruled = 'allow' THEN n ELSE 0 END) AS a,
      sum(CASE WHEN NOT calibrates AND ruled = 'block' THEN n ELSE 0 END) AS r FROM positions GROUP BY gram)"""]
    for k in range(order + 1):
        ctes.append(f"""t{k} AS (SELECT *, sum(a) OVER w AS na, sum(r) OVER w AS nr, sum(CAST(a > 0 AS INT)) OVER w AS ta,
      sum(CAST(r > 0 AS INT)) OVER w AS tr
      FROM (SELECT right(gram, {k + 1}) AS gram, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1)
      WINDOW w AS (PARTITION BY left(gram, {k})))""")
        q = (f"(SELECT *, 1.0::DOUBLE / {u.ALPHABET} AS qa, 1.0::DOUBLE / {u.ALPHABET} AS qr FROM t0)" if k == 0 else
             f"(SELECT t{k}.*, b.pa AS qa, b.pr AS qr FROM t{k} JOIN p{k - 1} b ON right(t{k}.gram, {k}) = b.gram)")
        ctes.append(f"p{k} AS (SELECT gram, " + ", ".join(
            f"CASE WHEN n{c} > 0 THEN (CAST({c} AS DOUBLE) + t{c} * q{c}) / (n{c} + t{c}) ELSE q{c} END AS p{c}" for c in "ar") + f" FROM {q})")
    ctes.append(f"""scored AS (SELECT t.*, floor(score * {u.BUCKETS}) AS bucket FROM texts t LEFT JOIN
      (SELECT host, path, avg(ln(pa) - ln(pr)) AS score FROM positions JOIN p{order} USING (gram) GROUP BY host, path) s USING (host, path))""")
    ctes.append("""lifted AS (SELECT bucket, ceil((bucket + coalesce(lag(bucket) OVER (ORDER BY bucket), bucket)) / 2) AS middle, coalesce(sum(r) OVER before, 0) AS blocked, coalesce(sum(a) OVER before, 0) AS lost,
      sum(a) OVER () AS all_a, sum(r) OVER () AS all_r
      FROM (SELECT bucket, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS r
            FROM scored WHERE calibrates AND bucket IS NOT NULL GROUP BY bucket)
      WINDOW before AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
    ctes.append("""threshold AS (SELECT middle FROM lifted WHERE all_a > 0 AND all_r > 0
      ORDER BY round(blocked / all_r - lost / all_a, 9) DESC, bucket LIMIT 1)""")
    return "WITH " + ",\n".join(ctes) + """
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bucket < (SELECT middle FROM threshold) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed JOIN scored USING (host, path)"""


def license_sql(sentences=licenses.SENTENCES, rules=licenses.RULES) -> str:
    known = ", ".join(f"{_text(licenses.normalised_text(s))}: {_text(name)}" for name, s in sentences.items())
    counts = ", ".join(
        f"{{'license': {_text(name)}, 'n': (length(line) - length(replace(line, {_text(p)}, ''))) // {len(p)}}}"
        for name, p in ((name, "|" + "||".join(sequence) + "|") for name, sequence in sorted(rules)))
    return rf"""WITH cut AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', E'\\1\n', 'g'), '[\n\r]+') AS s FROM documents),
ids AS (SELECT doc_id, list_filter(list_transform(s, lambda x: (MAP {{{known}}})[trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))]),
               lambda x: x IS NOT NULL) AS ids FROM cut),
lines AS (SELECT doc_id, ids, CASE WHEN len(ids) = 0 THEN '' ELSE '|' || array_to_string(ids, '||') || '|' END AS line FROM ids),
hits AS (SELECT doc_id, ids, list_filter([{counts}], lambda c: c.n > 0) AS hits FROM lines)
SELECT doc_id, array_to_string(list_transform(hits, lambda h: h.license), ';') AS licenses,
       CAST(coalesce(list_sum(list_transform(hits, lambda h: h.n)), 0) AS BIGINT) AS n_matches, CAST(len(ids) AS INT) AS n_sentences
FROM hits"""


def top_k_sql(k: int = 5, every: int = 50) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % {every} = 0 AND q.vec_id <> v.vec_id AND len(q.x) = len(v.x)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def mixing_sql(seed: int = mixing.SEED, temperature: float = mixing.TEMPERATURE) -> str:
    return f"""WITH volumes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source),
totals AS (SELECT sum(chars) AS c, sum(pow(chars, {temperature})) AS t FROM volumes WHERE chars > 0),
rates AS (SELECT source, round(CASE WHEN chars > 0 THEN pow(chars, {temperature}) / t * c * 1.0 / chars ELSE 1.0 END, 9) AS rate FROM volumes, totals),
terms AS (SELECT source, rate, k, sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(CAST(k AS DOUBLE)) END) OVER (PARTITION BY source ORDER BY k) AS log_factorial
  FROM (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k FROM rates)),
cdf AS (SELECT source, list(p ORDER BY k) AS cdf FROM (
  SELECT source, k, sum(CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - log_factorial) END) OVER (PARTITION BY source ORDER BY k) AS p
  FROM terms) GROUP BY source),
drawn AS (SELECT d.*, len(list_filter(cdf, lambda c: c < u)) AS n FROM (
    SELECT *, (CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {mixing.HEX_DIGITS}) AS BIGINT) + 0.5) * {mixing.UNIT!r} AS u
    FROM documents) d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
SELECT * EXCLUDE (n, u, mix_copy), CAST(mix_copy AS INT) AS mix_copy,
  md5('{seed}-order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(mix_copy AS VARCHAR)) AS mix_key
FROM (SELECT *, unnest(generate_series(1, n)) AS mix_copy FROM drawn WHERE n > 0)"""


ORACLE_SQL: dict[str, str] = {"op5_url_filter": url_sql(), "op7_licenses": license_sql(), "op8_top_k": top_k_sql(),
                              "op9_mix_sources": mixing_sql()}
