"""Queries of the corpus operators and the SQL that DuckDB can run beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import chat, decontaminate, conversations, idstore, language_model, neardup, packing, pieces, quality, secrets, sharding, vectors, whitening
from panelmill.llm.common import fold, table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), allowed=fold() != 0)
    scored = docs.select(F.col("doc_id"), (fold() == 0).alias("held_out"), quality.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = sharding.write_shards(docs, sharding.shared_dir(spark), shards=40)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # The digests are taken before the slots are joined, so the texts do not move a second time.
    digests = written.select(
        "doc_id",
        (F.octet_length(text) + sharding.ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "bucket",
        "place",
        sharding.shard_of("doc_id", 41, 20240229).alias("grown_shard"),
    )
    return sharding.with_slots(digests).drop("bucket", "place")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


#: A conversation whose texts hold the control strings of common templates.
HARD_TEXT = r"\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(hard)))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
    + length('<|turn|>') + 1 + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op9_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = idstore.write_ids(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return idstore.read_ids(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(table(spark, sf_dir, "conversations"))


#: crc32 of an ASCII text, bit by bit: each byte is followed by eight steps.
CRC32 = """list_reduce([4294967295] || flatten(list_transform(string_split({0}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"""
#: A state is {cost c, edits a, repaired r}. NONE cannot be reached.
NONE = "{'c': 1000000000, 'a': '', 'r': ''}"
_edit = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}', 'r': {0}.r || {3}}}".format  # from state, cost, initial, what is written
_least = lambda *states: f"list_sort([{', '.join(states)}])[1]"
_line = lambda role: f"chr(10) || {role} || ':'"
_insert = lambda state, role: _edit(state, 3, "I", _line(f"'{role}'"))
_keep = lambda state, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_edit(state, 'cut', 'K', _line('role') + ' || text')} ELSE {NONE} END"
_turn = lambda state, role: f"CASE WHEN NOT gone THEN {_edit(state, '3 + cut', 'R', _line(chr(39) + role + chr(39)) + ' || text')} ELSE {NONE} END"
_drop = lambda state: _edit(state, 4, "D", "''")


def _inserted(state: str) -> str:
    """States 0 to 3 after any inserts, as columns e0 to e3 of rows with columns b0 to b3."""
    return f"""SELECT *, {_least('e2b', 'b3')} AS e3 FROM (SELECT *, {_insert('e2', 'assistant')} AS e2b FROM (SELECT *, b0 AS e0, b1 AS e1, {_least('b2', _insert('b0', 'user'), _insert('b1', 'user'), _insert('b3', 'user'))} AS e2 FROM {state}))"""


OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")}, 4294967295) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM t WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]+\\z', '') AS body, left(role, 1) AS initial FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
g AS (SELECT *, fault IN (1, 2) AS gone, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cut FROM f),
walk(conv_id, i, b0, b1, b2, b3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 'r': ''}}, {NONE}, {NONE}, {NONE} FROM conversations
  UNION ALL SELECT conv_id, i, {_drop('e0')}, {_least(_drop('e1'), _keep('e0', 's'))},
    {_least(_drop('e2'), *(_keep(e, 'u') for e in ('e0', 'e1', 'e3')), *(_turn(e, 'user') for e in ('e0', 'e1', 'e3')))},
    {_least(_drop('e3'), _keep('e2', 'a'), _turn('e2', 'assistant'))}
  FROM (SELECT w.* EXCLUDE (i), g.i, g.role, g.text, g.initial, g.gone, g.cut FROM ({_inserted('walk')}) w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1)),
ends AS (SELECT conv_id, arg_max({_least('e0', 'e3')}, i) AS best FROM ({_inserted('walk')}) GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.r, 2)) AS repaired_sha256 FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.piece_digests(pieces.decode_pieces(pieces.encode_pieces(docs, path), path))


def queries() -> dict:
    return {"op1_quality": op1_quality, "op2_packing": op2_packing, "op9_idstore": op9_idstore, "op10_language_model": op10_language_model, "op3_sharding": op3_sharding, "op4_decontaminate": op4_decontaminate, "op5_neardup": op5_neardup, "op7_vectors": op7_vectors, "op6_chat": op6_chat, "op8_secrets": op8_secrets, "op11_conversations": op11_conversations, "op12_whitening": op12_whitening, "op13_pieces": op13_pieces}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": OP6_SQL, "op11_conversations": OP11_SQL}
