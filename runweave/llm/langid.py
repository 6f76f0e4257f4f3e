"""Language identification by compression.

For each language, training texts are joined into a raw-content zstandard dictionary.  A text is cut into blocks, each
block is compressed once, in lower case, with every language's dictionary, and the language that needs fewest bytes in total wins; where
the runner-up is nearly as small, the decision is marked as rejected.  All of every text is compressed.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.common import documents, literal_table
from runweave.llm.token_ids import forget_encoders

BLOCK = 4096  # characters that are compressed together
FILL = 256  # every block is repeated to at least this length, for the coder leaves tiny inputs as they are
# The documented bound of the fit: of each language, rows in the order of their hashes until pieces of PIECE characters fill
# DICT_BYTES, and SAMPLE rows at most.
SAMPLE, PIECE, DICT_BYTES = 400, 2000, 64 << 10
MARGIN = 0.001
LEVEL = 6
LETTER = re.compile(r"[^\W\d_]")


def sample_texts(df: DataFrame, lang: str, text: str, per_lang: int = SAMPLE, piece: int = PIECE, size: int = DICT_BYTES) -> dict[str, list[str]]:
    """Up to `per_lang` pieces of training text for each language, in an order fixed by the texts alone; a piece is `piece`
    characters at a place of the text that its hash chooses.  A bounded sample of labelled rows: what fills `size` bytes, of per_lang rows of each language at most."""
    usable = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND length(text) > 0")
    # only hashes are shuffled, first in many buckets, so that no language's rows meet in one task
    keyed = usable.withColumn("k", F.xxhash64("text"))
    part = keyed.select("lang", "k").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang", F.pmod("k", F.lit(64))).orderBy("k"))).filter(F.col("n") <= -(-per_lang // 16))
    best = part.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("k"))).filter(F.col("n") <= per_lang)
    chosen = F.broadcast(literal_table(df.sparkSession, [(r["lang"], r["k"]) for r in best.collect()], "lang string, k bigint"))
    place = F.pmod(F.xxhash64("k"), F.greatest(F.length("text") - piece, F.lit(0)) + 1).cast("int") + 1
    best = keyed.join(chosen, ["lang", "k"]).groupBy("lang", "k").agg(F.min(F.substring("text", place, F.lit(piece))).alias("piece"))
    before = F.coalesce(F.sum(F.octet_length("piece")).over(Window.partitionBy("lang").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found: dict[str, list[str]] = {}
    for r in best.withColumn("before", before).filter(F.col("before") < size).orderBy("lang", "k").collect():
        found.setdefault(r["lang"], []).append(r["piece"])
    return found


def dictionaries(samples: dict[str, list[str]], size: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw dictionary content per language, cut at `size` bytes and shorter only where the language's own texts are."""
    return {lang: "\n".join(dict.fromkeys(texts)).lower().encode()[:size] for lang, texts in sorted(samples.items())}


class Classifier:
    def __init__(self, raw: dict[str, bytes], margin: float = MARGIN, level: int = LEVEL):
        import zstandard as z

        def tool(data: bytes):
            data = ((data + b"\n") * -(-size // (len(data) + 1)))[:size] or b"\n"
            content = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            return z.ZstdCompressor(level=level, dict_data=content, write_content_size=False)

        # shorter dictionaries are repeated up to the size of the longest, for size alone changes how the coder works
        self.margin, self.langs, size = margin, sorted(raw), max(map(len, raw.values()), default=0)
        self.tools = [tool(raw[lang]) for lang in self.langs]
        self.short, self.neutral = {k for k, lang in enumerate(self.langs) if len(raw[lang]) < size}, [tool(b"")]

    def sizes(self, text: str, tools: list | None = None) -> list[int]:
        tools = self.tools if tools is None else tools
        total = [0] * len(tools)
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK].lower()
            block = (f"{block} " * -(-FILL // (len(block) + 1)) if len(block) < FILL else block).encode()
            for k, tool in enumerate(tools):
                total[k] += len(tool.compress(block))
        return total

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language or und, score, margin, rejected).  The margin is the part of its size that the best saves over the
        runner-up; the score maps it to 0..1.  Ties go to the language first in the alphabet."""
        if text is None or not LETTER.search(text) or not self.langs:
            return "und", 0.0, 0.0, True
        total = self.sizes(text)
        order = sorted(range(len(total)), key=lambda k: (total[k], k))
        if self.short.intersection(order[:2]):  # a filled dictionary has to help, not just to mislead the coder less
            least = self.sizes(text, self.neutral)[0]
            order = [k for k in order if k not in self.short or total[k] < least]
        if len(order) == 1:
            return self.langs[order[0]], 1.0, 1.0, False
        margin = (total[order[1]] - total[order[0]]) / max(1, total[order[1]])
        return self.langs[order[0]], min(1.0, 0.5 + 5 * margin), margin, margin < self.margin


def fit(train: DataFrame, lang: str = "lang", text: str = "text", per_lang: int = SAMPLE, size: int = DICT_BYTES) -> dict[str, bytes]:
    return dictionaries(sample_texts(train, lang, text, per_lang, size=size), size)


def identify(df: DataFrame, raw: dict[str, bytes], key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """key, lang_pred, score, margin, rejected for every row.

    A null text, or one without a letter, is `und` and rejected; a null key stays null; repeated rows each get a row;
    without any training text all rows are `und`.  Other columns are not looked at."""

    def run(batches):
        model = Classifier(raw, margin)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [model.classify(t) for t in part.column(1).to_pylist()]
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[key, "lang_pred", "score", "margin", "rejected"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` long, lang_pred string, score double, margin double, rejected boolean")


def keep_identified(df: DataFrame, raw: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """df's rows whose language is not rejected, with all their columns.

    Null texts, texts without a letter and, where nothing has been learnt, all texts are rejected; null keys and other nulls
    don't matter; repeated rows share their fate; an empty table gives an empty one."""

    def run(batches):
        forget_encoders()
        model = Classifier(raw, margin)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                yield part.filter(pa.array([not model.classify(t)[3] for t in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


def op9_language(spark, sf_dir):
    """Language of every document, learnt from those that aren't held out; for nulls, ties and empty tables see identify()."""
    docs = documents(spark, sf_dir)
    raw = fit(docs.filter(~held_out()))
    return identify(docs, raw).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
