"""One query per operator over the given tables, and SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetally.llm import toxicity
from pulsetally.llm.chat import read_back, render_turns, turns_of_table
from pulsetally.llm.common import given, stash
from pulsetally.llm.decontamination import contaminated
from pulsetally.llm.jaccard_join import jaccard_components
from pulsetally.llm.license_scan import scan_licenses
from pulsetally.llm.nearest import nearest
from pulsetally.llm.packing import pack_documents
from pulsetally.llm.prefix_trie import conversation_paths, trie_nodes
from pulsetally.llm.resampling import resample
from pulsetally.llm.secret_scan import scan_secrets
from pulsetally.llm.sharding import shard_by_bytes
from pulsetally.llm.token_rollup import TokenRollup, count_tokens
from pulsetally.llm.tokens import word_bpe_path
from pulsetally.llm.warc import deduplicate, read_headers, write_records
from pulsetally.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in every document."""
    return scan_licenses(given(spark, folder, "documents"))


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations rendered and read back, and one made of control strings."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"
    )
    rows = given(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turn_lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(render_turns(turns_of_table(rows))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn_lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, as counts, digest and spans."""
    base = F.filter("spans", lambda s: s["kind"] != "entropy")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan_secrets(given(spark, folder, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count("entropy"),
    )


def op4_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals after four batches over all documents.

    ``load`` inserts every document under both tokenizers. ``copies`` deletes those with
    the text of a smaller id, and is sent twice. ``words2`` revises the word counts of
    all documents left to version 2, which counts words that hold a letter or digit.
    """
    plain = F.length(F.regexp_replace(F.regexp_replace("text", "[^ \\t\\n\\x0B\\f\\r]+", "w"), "[^w]", ""))
    lettered = F.regexp_count("text", F.lit("[^ \\t\\n\\x0B\\f\\r]*[\\p{L}\\p{N}][^ \\t\\n\\x0B\\f\\r]*"))
    documents = given(spark, folder, "documents").select(
        "doc_id", "source", "lang", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"),
        F.coalesce(plain, F.lit(0)).alias("words1"), F.coalesce(lettered, F.lit(0)).alias("words2"),
    )
    counted = stash(
        count_tokens(documents, word_bpe_path(), ["doc_id", "source", "lang", "digest", "words1", "words2"]), "counts"
    )
    kept = counted.groupBy("digest").agg(F.min("doc_id").alias("first"))
    marked = stash(
        counted.join(kept, "digest").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))),
        "counts",
    )

    def change(rows: DataFrame, op: str) -> DataFrame:
        both = F.array(
            F.struct(F.lit("word_bpe_49k/1").alias("tokenizer"), F.col("n_tokens").alias("tokens")),
            F.struct(F.lit("words/1").alias("tokenizer"), F.col("words1").cast("long").alias("tokens")),
        )
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.inline(both))

    rollup = TokenRollup(spark, shared_dir(spark, "token-rollup"))
    rollup.commit("load", change(marked, "insert"))
    for _ in range(2):
        rollup.commit("copies", change(marked.filter("copy"), "delete"))
    rollup.commit(
        "words2",
        marked.filter("NOT copy").select(
            F.lit("revise").alias("op"), "source", "lang", F.lit("words/2").alias("tokenizer"),
            F.col("words2").alias("tokens"), F.lit("words/1").alias("old_tokenizer"), F.col("words1").alias("old_tokens"),
        ),
    )
    return rollup.totals()


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document; a fifth of the ids is held out from learning."""
    documents = given(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = toxicity.train(documents, given(spark, folder, "labels"), usable=~held_out)
    return toxicity.score(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard_by_bytes(given(spark, folder, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    asked = F.col("vec_id") % 100 == 0
    return nearest(given(spark, folder, "embeddings"), asked, 10).select("query_id", "rank", "vec_id", "score")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values."""
    return contaminated(given(spark, folder, "documents"), given(spark, folder, "benchmark"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(given(spark, folder, "documents"), word_bpe_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are 85 % alike."""
    return jaccard_components(given(spark, folder, "documents"), words=4, percent=85)


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a record of deduplicated archives, read back."""
    pages = given(spark, folder, "pages").select(F.col("page_id").alias("key"), "url", F.col("html").alias("payload"))
    index = write_records(pages, shared_dir(spark, "archives"))
    fresh = deduplicate(index, shared_dir(spark, "deduplicated"), least_bytes=100)
    return read_headers(fresh).select(
        F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )


def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's n-grams."""
    documents, benchmark = given(spark, folder, "documents"), given(spark, folder, "benchmark")
    return resample(documents, benchmark, keep=["doc_id"], percent=25, least_words=20, seed=7).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank"
    )


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all conversations, each of which begins with turns of its family's head."""
    conv_id = F.col("conv_id")
    paths = conversation_paths(
        given(spark, folder, "conversations"),
        family=conv_id - conv_id % 5,
        taken=F.crc32(conv_id.cast("string").cast("binary")) % 9,
    )
    return trie_nodes(stash(paths, "paths")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


QUERIES: dict[str, Query] = {
    "op1_licenses": op1_licenses,
    "op2_chat": op2_chat,
    "op3_secrets": op3_secrets,
    "op4_token_rollup": op4_token_rollup,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_nearest": op7_nearest,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_jaccard": op10_jaccard,
    "op11_warc": op11_warc,
    "op12_resampling": op12_resampling,
    "op13_prefix_trie": op13_prefix_trie,
}

#: The bit-wise CRC-32 of a string, as DuckDB macros: a table of one list, and the sum over the bytes.
_CRC32 = """
        crc_table AS MATERIALIZED (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
        )"""


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of ``text``'s UTF-8 bytes, next to ``crc_table``."""
    code = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({code}), 2), lambda i: ('0x' || substr({code}, i, 2))::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
        "lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"
    )


SQL: dict[str, str] = {
    "op2_chat": """
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                                  (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        ), sized AS (
            SELECT *, 23 + list_sum(list_transform([role, text], lambda x: length(
                replace(replace(replace(replace(replace(replace(replace(replace(x, '\\', '\\\\'),
                '<|', '<\\|'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'),
                '[/INST]', '[\\/INST]'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>')))) AS chars
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), ''
                                 ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                               FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op7_nearest": """
        WITH usable AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(
                list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank
            FROM pairs
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op10_jaccard": """
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2),
                    lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
            FROM worded
        ), shingles AS (
            SELECT doc_id, unnest(s) AS shingle FROM sets
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared
            JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
            WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
        ), reached AS (
            SELECT doc_id AS a, doc_id AS b FROM sets
            UNION
            SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        )
        SELECT doc_id, len(s)::BIGINT AS n_shingles, least_id AS component_id
        FROM sets JOIN (SELECT a, min(b) AS least_id FROM reached GROUP BY a) ON a = doc_id
    """,
    "op11_warc": """
        WITH payloads AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), digested AS (
            SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM payloads
        ), firsts AS (
            SELECT *, CASE WHEN payload_bytes >= 100
                THEN first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
                ELSE page_id END AS original,
                payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) > 1
                AS revisits
            FROM digested
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN revisits THEN original END AS refers_to
        FROM firsts
    """,
    "op12_resampling": f"""
        WITH {_CRC32.strip()}, texts AS (
            SELECT doc_id, true AS mine, row_number() OVER () AS row, text FROM documents
            UNION ALL
            SELECT NULL, false, row_number() OVER (), text FROM benchmark
        ), worded AS (
            SELECT doc_id, mine, row, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM texts
        ), found AS (
            SELECT mine, row, unnest(list_concat(w, list_transform(range(1, len(w)),
                lambda i: w[i] || ' ' || w[i + 1]))) AS feature
            FROM worded
        ), hashed AS (
            SELECT feature, {_crc32("feature")} % 10000 AS bucket
            FROM (SELECT DISTINCT feature FROM found), crc_table
        ), placed AS (
            SELECT mine, row, bucket FROM found JOIN hashed USING (feature)
        ), sums AS (
            SELECT bucket, count(*) FILTER (mine) AS s, count(*) FILTER (NOT mine) AS t FROM placed GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
                / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
            FROM sums
        ), weighed AS (
            SELECT row, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
            FROM placed JOIN gains USING (bucket) WHERE mine GROUP BY row
        ), scored AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                    / 4294967296)))::BIGINT AS score
            FROM worded LEFT JOIN weighed USING (row) WHERE mine
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
                   (25 * count(*) FILTER (n_words >= 20) OVER ()) // 100 AS drawn
            FROM scored
        )
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank
        FROM ranked
    """,
    "op13_prefix_trie": f"""
        WITH {_CRC32.strip()}, turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                    sha256(coalesce(role, '') || coalesce(text, ''))) AS place,
                {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list(said ORDER BY place) AS said FROM turns GROUP BY conv_id
        ), taken AS (
            SELECT conv_id, said, conv_id - conv_id % 5 AS head, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM own, crc_table
        ), rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(b.said, []).list_slice(1, c.h), c.said.list_slice(c.h + 1, len(c.said))) AS said
            FROM taken c LEFT JOIN own b ON b.conv_id = c.head
        ), hashed AS (
            SELECT conv_id, list_transform(said, lambda t: sha256(length(t.role) || ':' || t.role || t.text)) AS hashes,
                   list_transform(said, lambda t: octet_length(encode(t.text))) AS sizes
            FROM rebuilt
        ), prefixes AS (
            SELECT conv_id, len(hashes) AS turns, unnest(list_transform(range(len(hashes) + 1), lambda d: {{
                'depth': d, 'key': array_to_string(hashes[1:d], ''), 'size': CASE WHEN d = 0 THEN 0 ELSE sizes[d] END
            }}), recursive := true)
            FROM hashed
        ), nodes AS (
            SELECT key, depth, size, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
            FROM prefixes GROUP BY key, depth, size
        ), families AS (
            SELECT n.key, p.conv_id AS parent_conv_id, count(c.key) AS n_children
            FROM nodes n
            LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = left(n.key, 64 * (n.depth - 1))
            LEFT JOIN nodes c ON c.depth = n.depth + 1 AND left(c.key, 64 * n.depth) = n.key
            GROUP BY n.key, p.conv_id
        ), below AS (
            SELECT left(e.key, 64 * e.d) AS key, count(*) FILTER (n_children = 0) AS n_leaves,
                   sum((n_convs - 1) * size)::BIGINT AS saved_tokens
            FROM (SELECT *, unnest(range(depth + 1)) AS d FROM nodes) e
            JOIN families f ON f.key = e.key
            GROUP BY ALL
        )
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
        FROM nodes JOIN families USING (key) JOIN below USING (key)
    """,
}
