"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from veilframe.llm import quality as q

#: Byte sizes, CRC-32 by its table of 256 (made by rule), prefix sums and equal cuts.
SHARDS = r"""WITH RECURSIVE steps(n, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
tbl AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, size, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(size - 1), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))) AS bytes FROM d),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tbl),
p AS (SELECT *, SUM(size) OVER (ORDER BY doc_id) AS upto, SUM(size) OVER () AS total FROM c),
s AS (SELECT *, CAST(LEAST(7, 8 * (2 * (upto - size) + size) // (2 * total)) AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s"""


def quality() -> str:
    """The base counts, the sketches of the three levels, their limits and the verdict."""
    metrics = {k: v.replace(" div ", " // ") for k, v in q.METRICS.items()}
    levels = []
    for keys, k in (("lang, source", 0), ("lang", 1), ("", 2)):
        part, group = (f"{keys}, " if keys else ""), (f"GROUP BY {keys}" if keys else "")
        limits = ", ".join(f"MAX(CASE WHEN metric = '{m}' THEN b + {q.FENCE} * GREATEST(b - a, {q.FLOOR[m]}) END) AS {m}" for m in metrics)
        levels.append(
            f"""u{k} AS (SELECT {part}metric, value, SUM(SUM(1)) OVER (PARTITION BY {part}metric ORDER BY value) AS upto,
  SUM(SUM(1)) OVER (PARTITION BY {part}metric) AS n FROM m GROUP BY {part}metric, value),
q{k} AS (SELECT {part}metric, MIN(CASE WHEN 4 * upto >= n THEN value END) AS a, MIN(CASE WHEN 4 * upto >= 3 * n THEN value END) AS b, MAX(n) AS n
  FROM u{k} GROUP BY {part}metric),
l{k} AS (SELECT {part}MAX(n) AS n, {limits} FROM q{k} {group})"""
        )

    def limit(m: str) -> str:
        return f"CASE WHEN l0.n >= {q.MIN_DOCS} THEN l0.{m} WHEN l1.n >= {q.MIN_DOCS} THEN l1.{m} ELSE l2.{m} END"

    names = ", ".join(f"'{m}'" for m in metrics)
    values = ", ".join(f"CAST({e} AS BIGINT)" for e in metrics.values())
    bad = " OR ".join(f"COALESCE({e} > {limit(m)}, false)" for m, e in metrics.items())
    lines = r"list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    return rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
gs AS (SELECT doc_id, list_transform(range(1, greatest(1, len(ws) - 6)), lambda i: array_to_string(ws[i:i + 7], ' ')) AS g FROM w),
g AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM gs),
r AS (SELECT doc_id, i FROM g QUALIFY COUNT(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS _n_words, length(array_to_string(ws, '')) AS _word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS _n_symbols, len({lines}) - len(list_distinct({lines})) AS _n_dup_lines,
  len(ls) AS _n_lines, CAST(COALESCE(c.n, 0) AS BIGINT) AS _n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS _n_upper,
  length(regexp_replace(t, '[^!]', '', 'g')) AS _n_shouts FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
m AS (SELECT lang, source, unnest([{names}]) AS metric, unnest([{values}]) AS raw, greatest(0, length(bin(raw)) - {q.DIGITS}) AS cut, (raw >> cut) << cut AS value
  FROM f WHERE NOT {q.BASE_FAILED}),
{", ".join(levels)}
SELECT doc_id, _n_words AS n_words, _word_chars AS word_chars, _n_symbols AS n_symbols, _n_dup_lines AS n_dup_lines,
  _n_repeat_words AS n_repeat_words, {q.BASE_FAILED} AS base_failed, NOT {q.BASE_FAILED} AND NOT ({bad}) AS kept
FROM f LEFT JOIN l0 ON l0.lang IS NOT DISTINCT FROM f.lang AND l0.source IS NOT DISTINCT FROM f.source
  LEFT JOIN l1 ON l1.lang IS NOT DISTINCT FROM f.lang CROSS JOIN l2"""
