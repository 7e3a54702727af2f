"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor goes through a turn's parts in order.  Text is escaped; an image, audio or document part
becomes a numbered placeholder, whose reference and expanded token count are recorded.  Control
strings are ``<|name|>``; in texts every ``<`` is written ``<.``, so that no text, and no two texts that meet at a
joint of parts, can form the start of a control string, and the text can be read back from the output without loss.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm.common import table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PART = "struct<kind: string, text: string, ref: string, size: bigint>"
#: Endings of files by kind, and a link to one; all others are documents.
IMAGES, AUDIO, DOCUMENTS = ("png", "jpg", "jpeg", "gif", "webp"), ("mp3", "wav", "ogg", "flac"), ("pdf", "docx", "epub")
LINK = rf"https?://[^\x00-\x20<>|]+?\.(?:{'|'.join(IMAGES + AUDIO + DOCUMENTS)})(?!\.?[A-Za-z0-9/?=&%#_-])"
#: A link, or a run that begins like one and holds no ending: none of its later beginnings can be a link, so it is passed over whole, in one step.
LINK_OR_RUN = rf"({LINK})|(https?://[^\x00-\x20<>|]*+)"


@dataclass(frozen=True)
class Expansion:
    """Tokens of a placeholder once expanded: size (pixels, milliseconds, pages) divided by a unit, rounded up, times tokens of the unit; an unknown size counts as one unit."""

    image_unit: int = 28 * 28
    image_tokens: int = 1
    audio_unit: int = 40
    audio_tokens: int = 1
    document_unit: int = 1
    document_tokens: int = 256

    def count(self, kind: Column, size: Column) -> Column:
        units = lambda u, n: (F.ceil(F.greatest(F.coalesce(size, F.lit(u)), F.lit(0)) / u) * n).cast("bigint")
        return F.when(kind == "image", units(self.image_unit, self.image_tokens)).when(kind == "audio", units(self.audio_unit, self.audio_tokens)).when(kind == "document", units(self.document_unit, self.document_tokens)).otherwise(F.lit(0).cast("bigint"))


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<."))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<."), F.lit("<"))


def parts_of(text: Column) -> Column:
    """array of PART: a text cut at the links to files that it holds; joined in order, texts and refs give the text again.  Null: one empty text."""
    text = F.coalesce(text, F.lit(""))
    none = F.lit(None)
    # In an escaped text every < stands before a point, so <[ and <] mark the links' ends; runs without a link are left with empty marks.
    marked = F.regexp_replace(escape(text), LINK_OR_RUN, "<[$1<]$2")
    ending = lambda ref: F.lower(F.regexp_extract(ref, r"([A-Za-z0-9]+)$", 1))
    kind = lambda ref: F.when(ending(ref).isin(*IMAGES), "image").when(ending(ref).isin(*AUDIO), "audio").otherwise("document")
    part = lambda kind, text, ref: F.struct(kind.alias("kind"), text.cast("string").alias("text"), ref.cast("string").alias("ref"), none.cast("bigint").alias("size"))
    pieces = F.split(F.replace(marked, F.lit("<[<]"), F.lit("")), r"<[\[\]]")  # text, link, text, ...
    return F.transform(pieces, lambda x, i: F.when(i % 2 == 0, part(F.lit("text"), unescape(x), none)).otherwise(part(kind(x), none, x)))


def format_chats(turns: DataFrame, e: Expansion = Expansion()) -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, parts): conv_id, formatted, attachments, expanded_tokens.

    parts is an array of PART; kinds other than image, audio and document count as text.
    attachments: array of (index, kind, ref, tokens), numbered through the conversation in order.
    Turns go by turn (null first), then role, then their parts; repeated rows are turns like others.
    Null role, text, parts or part: empty.  Null conv_id: every such row is a conversation of its own, so no group gathers them.
    An empty table gives no rows.  Other columns are not read.
    """
    is_file = lambda k: F.coalesce(k.isin("image", "audio", "document"), F.lit(False))
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    chats = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    chats = chats.unionByName(turns.where("conv_id is null").select("conv_id", F.array(row).alias("turns")))
    # The number of a placeholder is the number of file parts before its turn, plus those before it within.
    files = F.transform("turns", lambda t: F.filter(t["parts"], lambda x: is_file(x["kind"])))
    flat = F.flatten(files)
    offsets = F.aggregate(files, F.array(F.lit(0)), lambda acc, f: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(f))))
    chats = chats.withColumn("offsets", offsets).withColumn("files", flat)

    def visit(part: Column, number: Column) -> Column:
        mark = F.concat(F.lit("<|"), part["kind"], F.lit(":"), number.cast("string"), F.lit("|>"))
        return F.when(is_file(part["kind"]), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))

    def turn(t: Column, i: Column) -> Column:
        before = lambda j: F.size(F.filter(F.slice(t["parts"], 1, j), lambda x: is_file(x["kind"])))
        body = F.array_join(F.transform(t["parts"], lambda x, j: visit(x, F.col("offsets")[i] + before(j))), "")
        return F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY), body, F.lit(END))

    attachments = F.transform("files", lambda f, i: F.struct(i.alias("index"), f["kind"].alias("kind"), f["ref"].alias("ref"), e.count(f["kind"], f["size"]).alias("tokens")))
    out = chats.select("conv_id", F.array_join(F.transform("turns", turn), "").alias("formatted"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array of (role, body), read back: role unescaped, body still escaped, with its placeholders."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, F.lit(1 << 30))
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, BODY, 1)).alias("role"), F.regexp_extract(p, r"(?s)<\|body\|>(.*)<\|end\|>$", 1).alias("body")))


def read_text(body: Column, files: Column) -> Column:
    """The text of a body that came from parts_of: unescaped, with the refs of files(index, ref, ...) for their placeholders."""
    pieces = F.split(body, r"<\|(?:image|audio|document):")
    number = lambda p: F.substring_index(p, "|>", 1).cast("int")
    back = lambda p, i: F.when(i == 0, unescape(p)).otherwise(F.concat(F.coalesce(F.get(files, number(p))["ref"], F.lit("")), unescape(F.substring(p, F.instr(p, "|>") + 2, F.length(p)))))
    return F.array_join(F.transform(pieces, back), "")


def op7_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations and conversation -1: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachments, expanded_tokens.

    Links to files in the texts are parts of their kind.  All but conv_id are read back from the formatted string and the
    attachments; see format_chats for odd rows.
    """
    rows = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    out = format_chats(rows.union(extra).withColumn("parts", parts_of(F.col("text"))))
    back = F.transform(read_turns(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), read_text(t["body"], F.col("attachments")).alias("text")))
    out = out.withColumn("back", back)
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("attachments").cast("bigint").alias("attachments"),
        "expanded_tokens",
    )


OP7_SQL = r"""
WITH t AS (
  SELECT *, row_number() OVER () AS rn FROM (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (
  SELECT *, regexp_extract_all(text || '  ', '(https?://[^\x00-\x20<>|]+?\.(?:png|jpg|jpeg|gif|webp|mp3|wav|ogg|flac|pdf|docx|epub))(?:\.[^A-Za-z0-9/?=&%#_-]|[^A-Za-z0-9/.?=&%#_-])', 1) AS links,
         CASE WHEN conv_id IS NULL THEN rn END AS own
  FROM t
), f AS (
  SELECT conv_id, own, rn, link, i - 1 AS i,
         CASE WHEN regexp_matches(lower(link), '(png|jpg|jpeg|gif|webp)$') THEN 'image' WHEN regexp_matches(lower(link), '(mp3|wav|ogg|flac)$') THEN 'audio' ELSE 'document' END AS kind
  FROM (SELECT conv_id, own, rn, link, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text, rn, k) AS i
        FROM (SELECT conv_id, own, rn, turn, role, text, unnest(links) AS link, unnest(range(len(links))) AS k FROM m))
), n AS (
  SELECT rn, count(*) AS files, sum(length(link)) AS plain, sum(length('<|' || kind || ':' || i || '|>')) AS marks, sum(CASE kind WHEN 'document' THEN 256 ELSE 1 END) AS tokens FROM f GROUP BY rn
), g AS (
  SELECT conv_id, own, count(*) AS n,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(replace(role, '<', '<.')) + length(replace(text, '<', '<.')) - coalesce(plain, 0) + coalesce(marks, 0) + 8 + 8 + 7) AS chars,
         coalesce(sum(files), 0) AS files, coalesce(sum(tokens), 0) AS tokens
  FROM m LEFT JOIN n USING (rn) GROUP BY conv_id, own
)
SELECT conv_id, n AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(files AS BIGINT) AS attachments, CAST(tokens AS BIGINT) AS expanded_tokens
FROM g
"""
