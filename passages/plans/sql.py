"""DuckDB SQL that the library's queries are compared with."""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
TOKEN = "[a-z0-9]+(?:-[a-z0-9]+)*"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def html_to_text(x: str) -> str:
    """For pages whose title holds no markup, with the character references that the given pages have."""
    quoted = r"""(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
    for tag in ("script", "style"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b{quoted}>.*?(?:</{tag}\b[^>]*>|\z)', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)</?[a-zA-Z]{quoted}>|<[!/?][^>]*>', ' ', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return clean(x)


def chunks(table: str, keys: str, text: str = "text", size: int = 120, overlap: int = 20) -> str:
    """SELECT of keys, chunk_no and text."""
    step = size - overlap
    return f"""SELECT {keys}, i::INT chunk_no, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text FROM
 (SELECT {keys}, w, unnest(range(0, ceil(greatest(len(w) - {size}, 0) / {step})::BIGINT + 1)) i FROM (SELECT {keys}, {words(text)} w FROM {table}) WHERE len(w) > 0)"""


#: Markdown documents made of conversations: (conv_id, text), a section for each turn.
MARKDOWN = "SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
#: Their sections: (conv_id, section_no, heading, body). Turns hold no heading lines.
SECTIONS = f"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT section_no, role heading, body FROM
 (SELECT conv_id, turn, role, {strip("replace(text, chr(13), '')")} body FROM conversations) WHERE body <> ''"""

def hashed(table: str, key: str, text: str = "text", dim_bits: int = 6) -> str:
    """SELECT of key and its hashing vector ``v``, as standins.hashing_embedder makes it."""
    digit = lambda at: f"('0x' || substr(h, {at}, 2))::INT"
    return f"""SELECT {key}, array_agg((CASE WHEN norm > 0 THEN coalesce(x, 0) / norm ELSE 0 END)::FLOAT ORDER BY dim) v FROM
 (SELECT {key}, unnest(range(0, {1 << dim_bits})) dim FROM {table}) LEFT JOIN
 (SELECT {key}, dim, x, sqrt(sum(x * x) OVER (PARTITION BY {key})) norm FROM
  (SELECT {key}, {digit(1)} & {(1 << dim_bits) - 1} dim, sum(CASE WHEN {digit(15)} >= 128 THEN 1.0 ELSE -1.0 END)::DOUBLE x FROM
   (SELECT {key}, md5(unnest({words(f"lower({text})")})) h FROM {table}) GROUP BY ALL)) USING ({key}, dim) GROUP BY {key}"""


#: Parts for WITH: c (chunks), tok, post, len_, st, idf, qt, bm (scores), kw (top k with zero fill).
BM25 = f"""c AS ({chunks("documents", "doc_id")}),
tok AS (SELECT doc_id, chunk_no, regexp_extract_all(lower(text), '{TOKEN}') t FROM c),
post AS (SELECT doc_id, chunk_no, term, count(*) tf FROM (SELECT doc_id, chunk_no, unnest(t) term FROM tok) GROUP BY ALL),
len_ AS (SELECT doc_id, chunk_no, len(t) dl FROM tok),
st AS (SELECT count(*) n_docs, coalesce(avg(dl), 0) avgdl FROM len_),
idf AS (SELECT term, count(*) df, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) idf FROM post, st GROUP BY term),
qt AS (SELECT query_id, term, count(*) times FROM (SELECT item_id query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, chunk_no, sum(times * idf * tf * 2.5 / (tf + CASE WHEN avgdl > 0 THEN 1.5 * (0.25 + 0.75 * dl / avgdl) ELSE 1.5 END)) score
 FROM post JOIN qt USING (term) JOIN idf USING (term) JOIN len_ USING (doc_id, chunk_no), st GROUP BY ALL)"""


def bm25_top(k: int) -> str:
    return f"""{BM25},
kw AS (SELECT query_id, doc_id, chunk_no, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id, chunk_no) rank FROM
 (SELECT * FROM bm UNION ALL SELECT q.query_id, f.doc_id, f.chunk_no, 0.0 FROM (SELECT DISTINCT item_id query_id FROM benchmark) q, (SELECT doc_id, chunk_no FROM len_ ORDER BY ALL LIMIT {k}) f
  WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.query_id = q.query_id AND bm.doc_id = f.doc_id AND bm.chunk_no = f.chunk_no)) QUALIFY rank <= {k})"""


COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def knn(k: int, queries: str = "vec_id % 50 = 0", where: str = "true") -> str:
    """SELECT of query_id, vec_id, score, rank."""
    return f"""SELECT q.vec_id query_id, a.vec_id, {COSINE} score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE}, 9) DESC, a.vec_id) rank
 FROM embeddings a, (SELECT * FROM embeddings WHERE {queries}) q WHERE {where} QUALIFY rank <= {k}"""


def ivf(clusters: int, seed: int = 0) -> str:
    """Parts for WITH: cen (cluster_id, v), asg (cluster_id, vec_id, embedding), prb (query_id, cluster_id, probe_rank)."""
    cos = "list_cosine_similarity(e.embedding::DOUBLE[], cen.v::DOUBLE[])"
    rank = f"row_number() OVER (PARTITION BY e.vec_id ORDER BY round({cos}, 9) DESC, cluster_id)"
    return f"""cen AS (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 cluster_id, v FROM (SELECT md5(vec_id || ':{seed}') h, vec_id, embedding v FROM embeddings ORDER BY h, vec_id LIMIT {clusters})),
asg AS (SELECT cluster_id, e.vec_id, e.embedding, {rank} r FROM embeddings e, cen QUALIFY r = 1),
prb AS (SELECT e.vec_id query_id, cluster_id, {rank} probe_rank FROM embeddings e, cen WHERE e.vec_id % 50 = 0)"""


def swept(configs: list[tuple[int, int]], weights: list[float], k: int) -> str:
    """Parts for WITH: sw (size, overlap, weight, query_id, doc_id, chunk_no, rank), blends over all chunks of each (size, overlap)."""
    cut = " UNION ALL ".join(f"SELECT {s}::INT size, {o}::INT overlap, * FROM ({chunks('documents', 'doc_id', 'text', s, o)})" for s, o in configs)
    key = "size, overlap, doc_id, chunk_no"
    return f"""sc AS MATERIALIZED ({cut}),
sk AS (SELECT {key}, regexp_extract_all(lower(text), '{TOKEN}') t FROM sc),
sp AS (SELECT {key}, term, count(*) tf FROM (SELECT {key}, unnest(t) term FROM sk) GROUP BY ALL),
ss AS (SELECT size, overlap, count(*) n_docs, avg(len(t)) avgdl FROM sk GROUP BY ALL),
si AS (SELECT size, overlap, term, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) idf, any_value(avgdl) avgdl FROM sp JOIN ss USING (size, overlap) GROUP BY ALL),
sq AS (SELECT query_id, term, count(*) times FROM (SELECT item_id query_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) term FROM benchmark) GROUP BY ALL),
sb AS (SELECT query_id, {key}, sum(times * idf * tf * 2.5 / (tf + CASE WHEN avgdl > 0 THEN 1.5 * (0.25 + 0.75 * len(t) / avgdl) ELSE 1.5 END)) w FROM sp JOIN sq USING (term) JOIN si USING (size, overlap, term) JOIN sk USING ({key}) GROUP BY ALL),
se AS MATERIALIZED ({hashed("sc", key)}), sv AS MATERIALIZED ({hashed("benchmark", "item_id")}),
sl AS MATERIALIZED (SELECT item_id query_id, se.size, se.overlap, se.doc_id, se.chunk_no, list_cosine_similarity(se.v::DOUBLE[], sv.v::DOUBLE[]) v, coalesce(w, 0) w
 FROM se CROSS JOIN sv LEFT JOIN sb ON sb.query_id = item_id AND sb.size = se.size AND sb.overlap = se.overlap AND sb.doc_id = se.doc_id AND sb.chunk_no = se.chunk_no),
sm AS (SELECT query_id, size, overlap, max(v) mv, max(w) mw FROM sl GROUP BY ALL),
sn AS (SELECT query_id, {key}, CASE WHEN mv = 0 THEN 0 ELSE v / mv END nv, CASE WHEN mw = 0 THEN 0 ELSE w / mw END nw FROM sl JOIN sm USING (query_id, size, overlap)),
sw AS (SELECT query_id, {key}, weight, row_number() OVER (PARTITION BY size, overlap, weight, query_id ORDER BY round(weight * nv + (1 - weight) * nw, 9) DESC, doc_id, chunk_no) rank
 FROM sn, (SELECT unnest({weights}::DOUBLE[]) weight) QUALIFY rank <= {k})"""
