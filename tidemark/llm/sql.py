"""DuckDB statements for the results of the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.decontaminate import MASKS
from tidemark.llm.mixing import NONE, REST, TOPICS

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
         sha1(coalesce(html, '')) AS digest
  FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""

NEAREST = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


def mixing(power: float = 0.7, rounds: int = 10, seed: int = 42) -> str:
    dims = ("source", "lang", "topic")
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS)
    parts = [
        f"""d AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
         CASE {topic} ELSE '{REST}' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) AS n_tokens,
         CAST(('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 12))
              AS BIGINT) / 281474976710656.0 AS u
  FROM documents
)""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for dim in dims:
        parts.append(f"t_{dim} AS (SELECT {dim}, pow(sum(tokens), {power}) AS w FROM c GROUP BY {dim})")
        parts.append(f"s_{dim} AS (SELECT {dim}, w / nullif(sum(w) OVER (), 0) AS share FROM t_{dim})")
    parts.append(
        "r0 AS MATERIALIZED (SELECT c.*, 1.0::DOUBLE AS weight, sum(tokens) OVER () AS m, a.share AS t_source, b.share AS t_lang, e.share AS t_topic "
        "FROM c JOIN s_source a USING (source) JOIN s_lang b USING (lang) JOIN s_topic e USING (topic))"
    )
    n = 0
    for _ in range(rounds):
        for dim in dims:
            now = f"sum(tokens * weight) OVER (PARTITION BY {dim})"
            parts.append(
                f"r{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * CASE WHEN {now} > 0 THEN m * t_{dim} / {now} "
                f"ELSE 1.0 END AS weight, m, t_source, t_lang, t_topic FROM r{n})"
            )
            n += 1
    parts.append(
        f"p AS (SELECT source, lang, topic, coalesce(least(1.0, weight / nullif(max(CASE WHEN tokens > 0 THEN weight END) OVER (), 0)), 1.0) "
        f"AS p FROM r{n})"
    )
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, "
        "round(p, 6) AS probability, u < p AS kept FROM d JOIN p USING (source, lang, topic)"
    )


def decontamination(least: float = 0.5, run: int = 5) -> str:
    """Seeds as joined words; the comparison of words on a diagonal is that of the operator."""
    words = lambda t: (
        f"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    )
    shortest = min(map(len, MASKS))

    def seeds(table: str, key: str) -> str:
        whole = f"SELECT {key}, 'w:' || array_to_string(w, ' ') AS seed, 0 AS pos FROM {table} WHERE len(w) < {shortest}"
        parts = [whole]
        for n, mask in enumerate(MASKS):
            counted = " || ' ' || ".join(f"w[pos + {i + 1}]" for i, c in enumerate(mask) if c == "1")
            parts.append(
                f"SELECT {key}, '{n}:' || {counted} AS seed, pos FROM "
                f"(SELECT {key}, w, unnest(range(0, len(w) - {len(mask) - 1})) AS pos FROM {table} WHERE len(w) >= {len(mask)})"
            )
        return " UNION ALL ".join(parts)

    window = 2 * run + 1
    return f"""
WITH items AS (
  SELECT w, min(item_id) AS item_id FROM (SELECT item_id, {words('text')} AS w FROM benchmark) WHERE len(w) > 0 GROUP BY w
), docs AS (SELECT doc_id, hash(coalesce(text, '')) AS h, {words('text')} AS w FROM documents),
i AS ({seeds('items', 'item_id')}),
d AS ({seeds('docs', 'doc_id, h')}),
hits AS (SELECT DISTINCT d.doc_id, d.h, i.item_id, d.pos - i.pos AS shift FROM d JOIN i USING (seed)),
dd AS (SELECT DISTINCT doc_id, h, w FROM docs),
equal AS (
  SELECT hits.doc_id, hits.h, hits.item_id, items.w AS iw,
         list_transform(range(0, len(items.w)), lambda k: CASE WHEN k + shift >= 0 AND k + shift < len(dd.w)
           AND dd.w[k + shift + 1] = items.w[k + 1] THEN 1 ELSE 0 END) AS e
  FROM hits JOIN items USING (item_id) JOIN dd ON dd.doc_id IS NOT DISTINCT FROM hits.doc_id AND dd.h = hits.h
), covered AS (
  SELECT doc_id, h, item_id, len(iw) AS n, unnest(list_filter(range(0, len(iw)), lambda k: e[k + 1] = 1 AND
         2 * coalesce(list_sum(list_slice(e, greatest(k - {run} + 1, 1), greatest(k - {run} + 1, 1) + {window - 1})), 0)
           >= least({window}, len(e)))) AS place
  FROM equal
), m AS (
  SELECT doc_id, h, item_id, n, count(DISTINCT place) AS matched FROM covered GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY matched / n DESC, item_id) AS k FROM m WHERE matched >= n * {least}
)
SELECT doc_id, item_id, CAST(matched AS INTEGER) AS matched, CAST(n AS INTEGER) AS item_words FROM r WHERE k = 1
"""
