"""Problem 9: one form for texts that look the same.

Canonical decomposition, then one table of replacements made by rule from the Unicode character data (full-width, narrow and
joined letters; white space; default-ignorable and control characters) and a fixed list of look-alike letters of other scripts,
then canonical composition. Case, accents, raised figures and the number of spaces and line breaks are kept; ``fold_case``
adds full case folding for comparisons that want it. Each distinct text of an Arrow batch is normalised once.

Defined cases: null gives null; a text without any visible character has no look key and stands in no pair; all texts are
processed whole; \\r\\n, \\r and the other line separators count as one line break each.
"""
from __future__ import annotations

import unicodedata
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Letters of other scripts and the Latin letter they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТХҮԌԚԜЗаеѕіјорсухһԁԛԝүӏ"
CYRILLIC_AS = "ABESIJKMHOPCTXYGQW3aesijopcyxhdqwyl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυϳϲχ"
GREEK_AS = "ABEZHIKMNOPTYXayiĸvopujcx"
ARMENIAN = "ՕՍԼոօսհց"
ARMENIAN_AS = "OULnouhg"
#: Hyphens that look like the hyphen-minus (longer dashes don't).
HYPHENS = (0x2010, 0x2011, 0x2043, 0x2D7, 0xFE63)
#: Default-ignorable code points (ranges of the Unicode property) and interlinear marks.
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
FORMS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}


def replacements() -> dict[int, str]:
    """code point -> replacement; values are canonically decomposed."""
    alike = {ord(a): b for s, t in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS)) for a, b in zip(s, t, strict=True)}
    table: dict[int, str] = {}
    for c in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        tag, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        kind = unicodedata.category(chr(c))
        if tag in FORMS and not rest.startswith("0020") and (tag != "<compat>" or kind[0] == "L"):
            table[c] = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", chr(c))).translate(alike)
        elif kind == "Cc":
            table[c] = ""
        if kind == "Zs":
            table[c] = " "
    table |= alike | {c: "" for c in range(32)} | {0x7F: "", 9: " ", 0x2800: " "}
    table |= dict.fromkeys(HYPHENS, "-")
    table |= dict.fromkeys((10, 11, 12, 13, 0x85, 0x2028, 0x2029), "\n")
    return table | {c: "" for a, b in IGNORABLE for c in range(a, min(b, 0xE01FF) + 1)}


def same_form(text: str, table: dict[int, str], fold_case: bool = False) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
    text = text.replace("\r\n", "\n")
    if fold_case:
        text = unicodedata.normalize("NFD", text.casefold())
    text = text.translate(table)
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def normalized(docs: DataFrame, fold_case: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, same): the text in its one form."""
    return _per_text(docs, lambda t: [t], [("same", pa.string())], "same string", fold_case)


def _per_text(docs: DataFrame, parts, fields, schema: str, fold_case: bool) -> DataFrame:
    table = replacements()

    def run(batches):
        for b in batches:
            coded = b.column(1).dictionary_encode()
            rows = [[None] * len(fields) if t is None else parts(same_form(t, table, fold_case)) + ([_digest(t)] if len(fields) > 1 else []) for t in coded.dictionary.to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind).take(coded.indices) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *(n for n, _ in fields)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def _digest(text: str) -> bytes:
    return blake2b(text.encode(), digest_size=16).digest()


def look_keys(docs: DataFrame, fold_case: bool = False) -> DataFrame:
    """(doc_id, look, own): 128-bit digests of the one form (null where nothing is visible) and of the text itself."""
    return _per_text(docs, lambda t: [_digest(t) if t.strip() else None], [("look", pa.binary()), ("own", pa.binary())], "look binary, own binary", fold_case)


def alike_pairs(docs: DataFrame, salts: int = 16) -> DataFrame:
    """(doc_id_a, doc_id_b): documents that look the same but differ as strings. Classes of equal texts are paired first, and
    members join their class under salts, so that a look or a text that many rows share is spread over tasks."""
    keys = materialize(look_keys(docs).where("look is not null and doc_id is not null"), "looks")
    mixed = keys.groupBy("look").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("look")
    rows = materialize(keys.join(mixed, "look"), "mixed")
    texts = rows.select("look", "own").distinct()
    pairs = texts.alias("p").join(texts.withColumnRenamed("own", "other").alias("q"), "look").where("own < other").select("look", "own", "other")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
    left = pairs.select("*", spread).join(salted, ["look", "own", "salt"]).select("look", "other", F.col("doc_id").alias("a"))
    right = salted.select("look", F.col("own").alias("other"), F.col("doc_id").alias("b"), "salt")
    both = left.select("*", spread).join(right, ["look", "other", "salt"])
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def p9_found(spark, d: str) -> DataFrame:
    return alike_pairs(spark.read.parquet(f"{d}/documents.parquet"))


def p9_folded(spark, d: str) -> DataFrame:
    """Classes of pages that are equal once case is folded too, by Unicode's full folding: (doc_id, looks, documents), the smallest
    document, how many different looks fall together and how many documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    looks = look_keys(docs).where("look is not null").select("doc_id", "look")
    both = look_keys(docs, True).where("look is not null").select("doc_id", F.col("look").alias("folded")).join(looks, "doc_id")
    one = both.groupBy("folded", "look").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return one.groupBy("folded").agg(F.min("first").alias("doc_id"), F.count("*").alias("looks"), F.sum("n").alias("documents")).where("looks > 1").drop("folded")


def p9_links(spark, d: str) -> DataFrame:
    """(doc_id, class_id, links): each page that others look like, its class by the smallest page, and how many pages look the same but
    differ as strings. Counts per text stand in for pairs, so a look that many pages share costs no more than its rows."""
    keys = materialize(look_keys(spark.read.parquet(f"{d}/documents.parquet")).where("look is not null and doc_id is not null"), "looks")
    texts = keys.groupBy("look", "own").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    every = texts.groupBy("look").agg(F.sum("n").alias("all"), F.min("first").alias("class_id"), F.count("*").alias("texts")).where("texts > 1")
    some = materialize(texts.join(every, "look").select("look", "own", "class_id", (F.col("all") - F.col("n")).alias("links")), "texts")
    return keys.join(some, ["look", "own"]).select("doc_id", "class_id", "links")


def p9_classes(spark, d: str) -> DataFrame:
    """For every look that several different texts share: its texts, its documents and its smallest document."""
    keys = look_keys(spark.read.parquet(f"{d}/documents.parquet")).where("look is not null")
    texts = keys.groupBy("look", "own").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return texts.groupBy("look").agg(F.min("first").alias("doc_id"), F.count("*").alias("texts"), F.sum("n").alias("documents")).where("texts > 1").drop("look")
