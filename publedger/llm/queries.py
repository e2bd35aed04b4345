"""One thin query for each operator, over whole tables, with check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from publedger.llm import (
    chat_format,
    conversation_trie,
    decontaminate,
    embedding_dedup,
    language_model,
    line_dedup,
    mixing,
    phrases,
    pii,
    simhash,
    substring_dedup,
    toxicity,
    warc,
)
from publedger.llm.common import LOWER, UPPER, WORD_CLASS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: DuckDB: the characters of the white space class.
SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def every_query() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All operators and the pipeline over them."""
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def every_check() -> dict[str, str]:
    import corpus_pipeline

    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def _sql_lower(expression: str) -> str:
    return f"translate({expression}, '{UPPER}', '{LOWER}')"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def hex_digits(value: Column) -> Column:
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


@query(
    "op1_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_sql_lower("coalesce(text, '')")}, '{decontaminate.WORD}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_sql_lower("text")}, '{decontaminate.WORD}') AS w FROM benchmark),
    spots AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
    windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS pattern FROM spots),
    places AS (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
    ),
    hits AS (
        SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS pattern FROM places)
        JOIN windows USING (n, pattern)
    ),
    words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = decontaminate.find_leaks(docs, table(spark, folder, "benchmark"), carry=["doc_id"])
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op2_mixing",
    f"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}')) AS size,
               CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
        FROM documents
    ),
    sums AS (
        SELECT source, sum(size) AS source_size,
               1.0 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight
        FROM sized GROUP BY source
    ),
    ranked AS (
        SELECT *, sum(3 * source_size) OVER w AS capped, sum(weight) OVER w AS closed, sum(weight) OVER () AS weights,
               sum(source_size) OVER () AS budget, 3 * source_size / weight AS bend,
               row_number() OVER (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST) AS place
        FROM sums WINDOW w AS (ORDER BY 3 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    level AS (
        SELECT coalesce(arg_min((budget - coalesce(capped, 0)) / (weights - coalesce(closed, 0)), place)
               FILTER (WHERE (budget - coalesce(capped, 0)) / (weights - coalesce(closed, 0)) <= bend), 0) AS level FROM ranked
    ),
    targets AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(least(3 * source_size, weight * level) AS DOUBLE) AS target FROM sums, level),
    placed AS (
        SELECT s.doc_id, size, source_size, target,
               sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS first
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target, CAST(
        greatest(0, least(size, floor(target) - first)) + greatest(0, least(size, floor(target) - first - source_size))
        + greatest(0, least(size, floor(target) - first - 2 * source_size)) AS BIGINT) AS taken
    FROM placed
    """,
)
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).drop("source")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.toxicity(docs.select("doc_id", "text"), labels, carry=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query(
    "op5_line_dedup",
    f"""
    WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts),
    keyed AS (SELECT *, {_sql_lower(f"trim(line, {SQL_SPACE})")} AS key FROM lines),
    shared AS (
        SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
        GROUP BY key HAVING count(DISTINCT doc_id) > 1
    ),
    marked AS (
        SELECT doc_id, pos, line, coalesce(doc_id > first_doc, false) AS dropped FROM keyed LEFT JOIN shared USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_pii")
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.count_of(base, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.dedup_substrings(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_embedding_dedup")
def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query(
    "op9_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f
    """,
)
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archive_and_read(table(spark, folder, "pages"), with_payload=False)
    return found.select("page_id", F.col("response.payload_bytes"), F.col("response.payload_digest"), "record_type", "refers_to")


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = language_model.train(docs.filter(~language_model.is_held_out()))
    scored = language_model.score(docs, model)
    return scored.select(
        "doc_id", language_model.is_held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query(
    "op11_phrases",
    f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex({_sql_lower("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
    ),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    sizes AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM p),
    spots AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sizes WHERE len(w) >= k),
    f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f FROM spots GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    cand AS (SELECT lang, k, g, string_split(g, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 30),
    cuts AS (SELECT *, unnest(range(1, k)) AS c FROM cand),
    measured AS (
        SELECT cuts.*, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS score FROM cuts
        JOIN f l ON l.lang = cuts.lang AND l.g = array_to_string(w[1:c], ' ')
        JOIN f r ON r.lang = cuts.lang AND r.g = array_to_string(w[c + 1:], ' ')
    ),
    lowest AS (SELECT * FROM measured QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
    inner_sizes AS (SELECT lang, w, a, k, unnest(range(2, k)) AS m FROM cand WHERE k > 2),
    inner_spots AS (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM inner_sizes),
    covers AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS g, max(a) AS longer FROM inner_spots GROUP BY ALL),
    kept AS (SELECT lowest.* FROM lowest LEFT JOIN covers USING (lang, g) WHERE NOT coalesce(100 * longer >= 80 * a, false))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
)
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents")).drop("words")


@query(
    "op12_conversation_trie",
    """
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL
    ),
    own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
    digits AS (SELECT conv_id, turns, list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS d FROM own),
    hashed AS (
        SELECT conv_id, turns, xor(4294967295, list_reduce(d, lambda a, b: list_reduce(
            list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 6 AS h
        FROM digits
    ),
    built AS (
        SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
        FROM hashed h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100
    ),
    steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built),
    nodes AS (
        SELECT turns[1:depth] AS path, depth, count(*) AS n_convs, min(conv_id) AS conv_id,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
        FROM steps GROUP BY 1, 2
    ),
    children AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
    worth AS (
        SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(path[depth].t) ELSE 0 END AS worth
        FROM nodes LEFT JOIN children USING (path, depth)
    ),
    climbs AS (SELECT path, worth, n_children, unnest(range(0, depth + 1)) AS depth FROM worth),
    subtrees AS (
        SELECT path[1:depth] AS path, depth, CAST(sum(worth) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
        FROM climbs GROUP BY 1, 2
    )
    SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
    FROM worth w JOIN subtrees USING (path, depth) LEFT JOIN nodes p ON p.depth = w.depth - 1 AND p.path = w.path[1:w.depth - 1]
    """,
)
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, ids = conversation_trie.mixed_histories(conversation_trie.hashed_turns(table(spark, folder, "conversations")))
    return conversation_trie.prefix_trie(turns, ids).drop("node", "parent")


#: The conversation that speaks in control strings.
CONTROL_TURNS = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def _sql_escaped(expression: str) -> str:
    pattern = chat_format.Template().pattern("")
    return f"regexp_replace({expression}, '{pattern}', '\\1\\3\\\\\\2\\4', 'g')"


@query(
    "op13_chat_format",
    f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum({sum(map(len, chat_format.Template().controls[:3]))} + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
    FROM rows GROUP BY conv_id
    """,
)
def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    told = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(told.unionByName(more)))
