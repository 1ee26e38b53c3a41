"""Language identification with bit-sliced Bloom filters.

One table of slots serves all languages: a slot holds a bitmask of languages, of as
many 60-bit words as there are languages for, so the AND of an n-gram's ``HASHES``
slots names every language whose filter has it.  The table's size follows the number
of learned n-grams.
A text's n-grams are looked up at once and a population count a language, put
right for that language's false positives, decides.  The filters hold the
n-grams that are typical of a language: those whose share there is at least
``SHARE`` of their largest share in any language.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from kestrel.llm.common import materialise, scratch, table, tune, worker_cache

#: Slots of the filter table for each n-gram it holds, and the table's bounds: 2^22 slots are 32 MB a mask word.
SLOTS_A_GRAM, LEAST_BITS, MOST_BITS = 12, 12, 22
#: Languages of a mask word.
WORD = 60
HASHES = 3
SHARE = 0.25
GRAM = 3
#: Documents of which any filters hold a smaller share are in no learned language; mixed ones are in several.
REJECT_BELOW = 0.5


def _symbols(text: str):
    """Code points of a lower-cased text, each run of other signs one blank, a blank at both ends."""
    import numpy as np

    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = worker_cache("letters", lambda: np.array([chr(p).isalpha() for p in range(0x110000)]))[points]
    out = np.zeros(len(points) + 2, np.uint32)
    out[1:-1] = np.where(letter, points, 32)
    out[0] = out[-1] = 32
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def _grams(text: str | None):
    """63-bit codes of all n-grams of a text, exact for n-grams of three code points; None without a letter."""
    import numpy as np

    if not text:
        return None
    s = _symbols(text).astype(np.int64)
    if len(s) < GRAM:
        return None
    code = s[: len(s) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code = (code << 21) | s[k : len(s) - GRAM + 1 + k]
    return code


def _slots(codes, bits: int):
    """HASHES slot numbers below 2^bits an n-gram, by double hashing of a mixed code."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = codes.astype(np.uint64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        a, b = z & np.uint64((1 << 32) - 1), (z >> np.uint64(32)) | np.uint64(1)
        return [((a + np.uint64(k) * b) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(HASHES)]


def _count(batches):
    """Partial n-gram counts a language; merged and flushed so that a task holds a bounded table."""
    import numpy as np

    held: dict[str, list] = {}
    size = 0

    def merged():
        for lang, parts in held.items():
            codes = np.concatenate([c for c, _ in parts])
            order, back = np.unique(codes, return_inverse=True)
            yield lang, order, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def flush():
        for lang, codes, n in merged():
            for at in range(0, len(codes), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes[part]), pa.string()), "code": pa.array(codes[part]), "n": pa.array(n[part])})

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes = _grams(text)
            if codes is not None:
                unique, n = np.unique(codes, return_counts=True)
                held.setdefault(lang, []).append((unique, n))
                size += len(unique)
            if size > 1_000_000:
                held = {k: [(c, n)] for k, c, n in merged()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > 500_000:
                    yield from flush()
                    held, size = {}, 0
    yield from flush()


class LanguageModel:
    """Learned filters: language names, slot masks (mask words x slots), false-positive rates of each language and of any."""

    def __init__(self, languages: list[str], masks, rates, any_rate: float):
        self.languages, self.masks, self.rates, self.any_rate = languages, masks, rates, any_rate

    def seen(self, codes):
        """(n-grams that each language's filter holds, n-grams that any holds), as counts."""
        import numpy as np

        counts, known = [], np.zeros(len(codes), bool)
        slots = _slots(codes, self.masks.shape[1].bit_length() - 1)
        for k, mask in enumerate(self.masks):
            hit = mask[slots[0]]
            for more in slots[1:]:
                hit = hit & mask[more]
            known |= hit != 0
            counts += [int(((hit >> mask.dtype.type(j)) & mask.dtype.type(1)).sum()) for j in range(min(WORD, len(self.languages) - k * WORD))]
        return np.array(counts), int(known.sum())


def _least_count(typical: DataFrame) -> tuple[int, int]:
    """(least count of an n-gram for the table to hold it, n-grams that have it): 2, or more where the table would overflow."""
    room = (1 << MOST_BITS) // SLOTS_A_GRAM
    sizes = typical.groupBy("code").agg(F.max("top_n").alias("top_n")).groupBy(F.ceil(F.log2("top_n")).cast("int").alias("octave")).count().orderBy(F.desc("octave")).collect()
    held, least = 0, 2
    for octave, n in sizes:  # at most 63 rows, the most frequent first
        if held + n > room:
            least = max(2, (1 << octave) + 1)
            break
        held += n
    return least, held


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Learn from all rows with a language; n-gram counts are one distributed aggregation.

    An n-gram enters the filters with a count of 2, or, where more than the largest
    table holds would, with the count that the table has room for.  What reaches the
    driver is the table, at most 2^MOST_BITS rows, and a row a language.  Null
    languages and null or letterless texts teach nothing.
    """
    tune(df.sparkSession)
    with scratch(df.sparkSession):
        return _train(df, lang_col, text_col)


def _train(df: DataFrame, lang_col: str, text_col: str) -> LanguageModel:
    import numpy as np

    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = materialise(rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "language-grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    words = max(1, -(-len(languages) // WORD))
    if not languages:
        return LanguageModel([], np.zeros((1, 1 << LEAST_BITS), np.uint8), np.zeros(0), 0.0)
    rows = [(name, 1.0 / totals[name], k // WORD, 1 << k % WORD) for k, name in enumerate(languages)]
    about = df.sparkSession.createDataFrame(rows, "lang string, scale double, word int, bit long")  # a row a language
    rated = counts.join(F.broadcast(about), "lang").withColumn("share", F.col("n") * F.col("scale"))
    best = rated.groupBy("code").agg(F.max_by("n", "share").alias("top_n"), F.max("share").alias("top"))
    typical = rated.join(best, "code").where((F.col("share") >= SHARE * F.col("top")) & (F.col("top_n") >= 2))
    typical = materialise(typical.select("code", "word", "bit", "top_n"), "typical-grams")
    least, held = _least_count(typical)
    bits = min(MOST_BITS, max(LEAST_BITS, (SLOTS_A_GRAM * held - 1).bit_length()))

    def deal(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy()
            for slots in _slots(codes, bits):
                yield pa.RecordBatch.from_arrays([pa.array(slots), batch.column(1), batch.column(2)], ["slot", "word", "bit"])

    dealt = typical.where(F.col("top_n") >= least).select("code", "word", "bit").mapInArrow(deal, "slot long, word int, bit long")
    table_rows = dealt.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    masks = np.zeros((words, 1 << bits), np.uint8 if len(languages) <= 8 else np.uint64)
    masks[table_rows.column("word").to_numpy(), table_rows.column("slot").to_numpy()] = table_rows.column("mask").to_numpy().astype(masks.dtype)
    kind = masks.dtype.type
    rates = np.array([((masks[k // WORD] >> kind(k % WORD)) & kind(1)).mean() ** HASHES for k in range(len(languages))])
    return LanguageModel(languages, masks, rates, float(1 - np.prod([1 - float((m != 0).mean()) ** HASHES for m in masks])))


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """df with the predicted language, a score and a known share from 0 to 1 at its end.

    The score is the share of a text's n-grams that the winner's filter holds, the
    known share that which any language's filter holds, false positives taken off
    both; ties go to the first name.  Columns of df that have the result's names give
    way to it.  Texts that are null or have no letter, and all
    texts under a model without languages, are ``und`` with score and share 0.
    """
    spark = df.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches):
        import numpy as np

        model = shared.value
        for batch in batches:
            names, scores, known = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                codes = _grams(text) if model.languages else None
                if codes is None:
                    names.append("und")
                    scores.append(0.0)
                    known.append(0.0)
                    continue
                seen, some = model.seen(codes)
                share = np.clip((seen / len(codes) - model.rates) / np.maximum(1e-12, 1 - model.rates), 0, 1)
                k = int(np.argmax(share))
                names.append(model.languages[k])
                scores.append(float(share[k]))
                known.append(min(1.0, max(0.0, (some / len(codes) - model.any_rate) / max(1e-12, 1 - model.any_rate))))
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "__k_lang", "__k_score", "__k_known"])

    kept = [f.name for f in df.schema.fields if f.name not in out]
    packed = df.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias("__k_text"))
    schema = StructType([f for f in df.schema.fields if f.name not in out]).add("__k_lang", StringType()).add("__k_score", DoubleType()).add("__k_known", DoubleType())
    return packed.mapInArrow(predict, schema).withColumnsRenamed(dict(zip(("__k_lang", "__k_score", "__k_known"), out)))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them.

    Held out are the documents whose crc32 of the id's digits is 2 modulo 4; the
    digits of a null id are taken as empty.  Repeated rows come back as often as
    they are there; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents", dealt=True)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    docs = docs.select("doc_id", (fold == 2).alias("held_out"), "lang", "text")
    model = train(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def reject_unknown(df: DataFrame, lang_col: str = "lang", text_col: str = "text", below: float = REJECT_BELOW) -> DataFrame:
    """df without the documents that are in none of the languages learned from it.

    Documents in several of them stay.
    """
    found = identify(df, train(df, lang_col, text_col), text_col, ("__k_lang", "__k_score", "__k_known"))
    return found.where((F.col("__k_lang") != "und") & (F.col("__k_known") >= below)).select(*(f"`{c}`" for c in df.columns))
