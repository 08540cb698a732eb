"""One consistent form for texts that look the same but differ in their characters (a confusables skeleton)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from massloom.operators.heavy_keys import skew_join
from massloom.session import durable_table

# Letters and the letter they look like, by alphabet, in the order of the alphabets.
LOOK_ALIKES = {
    ord(a): b
    for letters, prototypes in (
        ("ıɑɡɩɪʏᴄᴏᴜᴠᴡᴢꜱƽ", "iagiiycouvwzss"),  # Latin
        ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϺ", "ABEZHIKMNOPTYXCJM"),  # Greek
        ("αγινορσυϲϳ", "ayivopoucj"),
        ("ЅІЈАВЕКМНОРСТУХҮӀԌԚԜѴ", "SIJABEKMHOPCTYXYlGQWV"),  # Cyrillic
        ("аеорсухѕіјһӏԁԛԝүѵ", "aeopcyxsijhldqwyv"),
        ("ՕՏՍ", "OSU"),  # Armenian
        ("գզհոռսցքօ", "qqhnnugfo"),
        ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏚᏙᏕᏞᏟᏢᏦᏧᏴ", "DRTiAJEWMHYGZRWSVSLCPKdB"),  # Cherokee
        ("ⲎⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HKMNOPCTYXopc"),  # Coptic
        ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAElOU"),  # Lisu
        ("µ", "μ"),
    )
    for a, b in zip(letters, prototypes, strict=True)
}
#: Code points that may be replaced: all but the ideographs and syllables, which have no form of another character here.
RANGES = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x1F800), (0xE0000, 0xE0200))


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str | None], dict[int, str | None]]:
    """What is replaced before and after decomposition, by rule from the character database and the table above.

    Wide, narrow, no-break and font forms become what they are a form of, and so do letters and letter numbers that are made of
    plain letters (ligatures, Roman numerals); raised, lowered and circled forms stay. Blanks of every kind become the plain
    blank; line ends become the line feed; characters that print nothing go.
    """
    first: dict[int, str | None] = {}
    for cp in (c for lo, hi in RANGES for c in range(lo, hi)):
        ch = chr(cp)
        tag = unicodedata.decomposition(ch).partition(" ")[0]
        kind = unicodedata.category(ch)
        whole = unicodedata.normalize("NFKC", ch) if tag == "<compat>" and kind[0] in "LN" else ""
        if tag in ("<wide>", "<narrow>", "<noBreak>", "<font>") or (whole.isascii() and whole.isalpha()):
            first[cp] = unicodedata.normalize("NFKC", ch)
        if kind == "Zs":
            first[cp] = " "
        elif kind in ("Zl", "Zp"):
            first[cp] = "\n"
        elif kind in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            first[cp] = None
        elif 0xFB00 <= cp <= 0xFB06:
            first[cp] = unicodedata.normalize("NFKC", ch)
    for cp in (*range(0x20), 0x7F):
        first[cp] = None
    first |= {0x09: " ", 0x0A: "\n", 0x0D: "\n", 0x85: "\n"}
    return first, LOOK_ALIKES


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again."""
    first, second = _tables()
    form = unicodedata.normalize("NFD", text.replace("\r\n", "\n").translate(first))
    return unicodedata.normalize("NFD", form.translate(second))


#: Words whose skeletons a task remembers; it starts anew beyond that.
REMEMBERED = 300_000


def skeletons(texts: list[str | None]) -> list[str | None]:
    """The skeletons of many texts, word by word: the plain blank stands alone in every form, so words can be formed alone."""
    known: dict[str, str] = {}

    def form(word: str) -> str:
        got = known.get(word)
        if got is None:
            if len(known) >= REMEMBERED:
                known.clear()
            got = known[word] = skeleton(word)
        return got

    return [
        t if t is None or (t.isascii() and t.isprintable()) else " ".join(map(form, t.split(" "))) for t in texts
    ]


def with_skeleton(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text`` and ``skeleton``. A null text has a null skeleton, an empty one an empty skeleton."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = skeletons(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forms, pa.string())], names=["k", "text", "skeleton"])

    key_type = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return rows.mapInArrow(build, f"k {key_type}, text string, skeleton string").withColumnRenamed("k", key)


def same_look_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``look`` (a digest of the skeleton) and ``form`` (a digest of the characters) of texts with a visible character."""
    formed = with_skeleton(docs, key, text)
    return formed.where(F.trim(F.translate("skeleton", "\n", " ")) != "").select(
        key, F.unhex(F.md5("skeleton")).alias("look"), F.unhex(F.md5("text")).alias("form")
    )


def same_look_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``class_id``, ``n_texts``, ``n_forms``: the least key among the texts of a look, how many there are and in how many forms.

    A row for each text with a visible character, copies too; nothing is expanded into pairs. A look that many texts have is
    joined by broadcast, so it's left to no single task. Null keys come out, but name no class if another key is there.
    """
    groups = durable_table(same_look_groups(docs, key, text).withColumn("look", F.hex("look")))
    forms = groups.groupBy("look", "form").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n"))  # combined before the shuffle
    looks = forms.groupBy("look").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_texts"), F.count(F.lit(1)).alias("n_forms"))
    return skew_join(groups.select(key, "look"), looks, "look").select(key, "class_id", "n_texts", "n_forms")


def same_look_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``a`` < ``b``: the pairs of texts that look the same but are not the same characters.

    Exact copies are paired with the other forms, not with each other: forms of a look are paired first, so a group of
    many copies never meets itself. Texts that are null or without a visible character are in no pair. Repeated rows of
    a key count once. An empty table gives an empty result.
    """
    groups = durable_table(same_look_groups(docs, key, text).withColumnRenamed(key, "id"))  # two digests a text
    several = groups.groupBy("look").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo < hi").select("look")
    kept = groups.join(several, "look", "left_semi").distinct()
    forms = kept.select("look", "form").distinct()
    pairs = forms.alias("x").join(forms.alias("y"), "look").where("x.form < y.form")
    pairs = pairs.select("look", F.col("x.form").alias("form_x"), F.col("y.form").alias("form_y"))
    x = kept.select("look", F.col("form").alias("form_x"), F.col("id").alias("id_x"))
    y = kept.select("look", F.col("form").alias("form_y"), F.col("id").alias("id_y"))
    return (
        pairs.join(x, ["look", "form_x"])
        .join(y, ["look", "form_y"])
        .select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
        .where("a < b")
        .distinct()
    )
