"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadwright.llm.common import mapped

#: Characters of the longest n-gram; a key holds 16 bits of each.
ORDER = 4
#: Labelled documents of a language that its model is fitted on, about, and as many that its rejection is calibrated on.
SAMPLE = 2000
#: A text may be SLACK times as far off its language as this share of the calibration texts of about its length are.
QUANTILE, SLACK = 0.95, 2.5
#: The share of the way from the language to random letters that a rejected text is beyond, at any length.
BEYOND = 1 / 3
#: Calibration texts of a range of lengths, at least: shorter ranges join the next.
IN_RANGE = 50
#: Text that is scored at once.
CHUNK = 1 << 18


#: Letters above the first plane are told apart in this many code points of the private use area, which no letter of the first plane has.
PRIVATE, PLACES = 0xE000, 6400


def _folded(code: int) -> int:
    """A letter's or a mark's 16 bits: its lower case, in the private use area for those above the first plane; a space for other characters."""
    char = chr(code)
    if unicodedata.category(char)[0] not in "LM":
        return 32
    code = ord(char.lower()) if len(char.lower()) == 1 else code
    return code if code < 1 << 16 else PRIVATE + code % PLACES


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane: its 16 bits, and whether it is a letter; a mark alone is none."""
    table = np.array([_folded(code) for code in range(1 << 16)], np.uint64)
    return table, np.array([unicodedata.category(chr(code))[0] == "L" for code in range(1 << 16)])


def keys_of(texts: list[str | None], letters: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram keys of several texts, how many each text has, and each text's number of letters.

    Letters and their marks are lower-cased, each run of other characters is one space, and a text stands after ORDER - 1
    spaces and before one, so it has a key for every letter, mark and space.
    """
    table, is_letter = letters
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes])
    flat = np.concatenate([np.concatenate([np.zeros(ORDER - 1, np.uint32), c, np.zeros(1, np.uint32)]) for c in codes]) if codes else np.zeros(0, np.uint32)
    high = np.flatnonzero(flat >= 1 << 16)
    low = np.minimum(flat, (1 << 16) - 1)
    mapped, letter = table[low], is_letter[low]
    if len(high):
        kinds, which = np.unique(flat[high], return_inverse=True)
        mapped[high] = np.array([_folded(int(c)) for c in kinds], np.uint64)[which]
        letter[high] = np.array([unicodedata.category(chr(c))[0] == "L" for c in kinds])[which]
    owner = np.repeat(np.arange(len(texts)), sizes + ORDER)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes + ORDER) - (sizes + ORDER), sizes + ORDER)
    keep = np.ones(len(flat), bool)
    keep[1:] = (mapped[1:] != 32) | (mapped[:-1] != 32) | (place[1:] < ORDER)
    lead = place < ORDER - 1
    mapped, owner, lead, letter = mapped[keep], owner[keep], lead[keep], letter[keep]
    key = mapped.copy()
    for i in range(1, ORDER):
        key[i:] |= mapped[:-i] << np.uint64(16 * i)
    key, owner, letter = key[~lead], owner[~lead], letter[~lead]
    n = np.bincount(owner, minlength=len(texts))
    return key, n, np.bincount(owner[letter], minlength=len(texts))


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the keys stand there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Model:
    """Interpolated Kneser-Ney probabilities of one language's n-grams, in sorted arrays of their keys.

    The longest n-grams count as often as they occur, shorter ones by how many different characters stand before them. Each
    order's discount is n1 / (n1 + 2 n2) of its counts; what it takes away goes to the order below, and the lowest order
    shares with the uniform distribution over the alphabet and one unknown character.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.orders: list[tuple] = []
        order, keys, counts = ORDER, keys.astype(np.uint64), counts.astype(np.float64)
        while order:
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            contexts, where = np.unique(keys >> np.uint64(16), return_inverse=True)
            self.orders.append((order, keys, counts, contexts, np.bincount(where, counts), np.bincount(where).astype(np.float64), discount))
            order -= 1
            if order:
                keys, counts = np.unique(keys & np.uint64((1 << 16 * order) - 1), return_counts=True)
                counts = counts.astype(np.float64)
        self.uniform = 1.0 / (len(self.orders[-1][1]) + 1)

    def probability(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        if level == len(self.orders):
            return np.full(len(keys), self.uniform)
        order, known, counts, contexts, totals, kinds, discount = self.orders[level]
        below = self.probability(keys & np.uint64((1 << 16 * (order - 1)) - 1) if order > 1 else keys, level + 1)
        at, there = find(contexts, keys >> np.uint64(16))
        k, seen = find(known, keys)
        total, count = np.where(there, totals[at], 1.0), np.where(seen, counts[k], 0.0)
        return np.where(there, (np.maximum(count - discount, 0.0) + discount * kinds[at] * below) / total, below)


class Identifier:
    """The languages' models, the table of all n-grams that any of them knows, and each language's limit of rejection."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.models = [Model(*counts[lang]) for lang in self.langs]
        self.known = np.unique(np.concatenate([m.orders[0][1] for m in self.models])) if self.models else np.zeros(0, np.uint64)
        self.table = np.stack([np.log2(m.probability(self.known)) for m in self.models], 1) if self.models else np.zeros((0, 0))
        self.limits = {lang: (np.inf, -np.log2(m.uniform)) for lang, m in zip(self.langs, self.models)}
        self.ranges: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.letters = _letters()

    def state(self) -> dict:
        """Plain values and arrays that stand for it in a broadcast, so that workers need not import this module."""
        return vars(self) | {"models": [vars(m) for m in self.models]}

    @classmethod
    def of(cls, state: dict) -> Identifier:
        out = cls.__new__(cls)
        vars(out).update(state, models=[])
        for values in state["models"]:
            out.models.append(Model.__new__(Model))
            vars(out.models[-1]).update(values)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character under each language (texts x languages), the texts' keys and their letters."""
        keys, n, letters = keys_of(texts, self.letters)
        at, there = find(self.known, keys)
        bits = self.table[at] if len(self.known) else np.zeros((len(keys), len(self.langs)))
        if not there.all():
            new, where = np.unique(keys[~there], return_inverse=True)
            bits[~there] = np.stack([np.log2(m.probability(new)) for m in self.models], 1)[where]
        sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0) if len(n) else bits
        return -sums / n[:, None], n, letters

    def calibrate(self, lang: str, bits: np.ndarray, n: np.ndarray) -> None:
        """Learn the language's weighted median, and by doubling ranges of length how far from it, times the root of the length, QUANTILE of its texts lie."""
        order = np.argsort(bits)
        upto = np.cumsum(n[order])
        middle = float(bits[order][np.searchsorted(upto, upto[-1] / 2)])
        self.limits[lang] = middle, self.limits[lang][1]
        away, doublings = (bits - middle) * np.sqrt(n), np.floor(np.log2(n))
        starts, far, first = [], [], 0.0
        for d in np.unique(doublings):
            within = (doublings >= first) & (doublings <= d)
            left = (doublings > d).sum()
            if within.sum() >= IN_RANGE and left >= IN_RANGE or not left:
                starts.append(2.0**first)
                far.append(max(1.0, float(np.quantile(away[within], QUANTILE))))
                first = d + 1
        self.ranges[lang] = np.array(starts), np.array(far)

    def rejects(self, lang: str, bits: float, n: int) -> bool:
        """Whether a text is SLACK times further off than QUANTILE of the language's calibration texts of its length, and BEYOND the way to random letters."""
        if lang not in self.ranges:
            return False
        (middle, random), (starts, far) = self.limits[lang], self.ranges[lang]
        limit = far[max(0, np.searchsorted(starts, n, "right") - 1)]
        return (bits - middle) * np.sqrt(n) > SLACK * limit and bits - middle > BEYOND * (random - middle)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """Language, score, bits a character and whether it is rejected, for each text."""
        if not self.langs or not texts:
            return [("und", 0.0, 0.0, True) for _ in texts]
        bits, n, letters = self.entropies(texts)
        best = bits.argmin(1)
        weight = np.exp2(np.minimum(0.0, (bits.min(1)[:, None] - bits) * np.sqrt(n)[:, None]))
        score = 1.0 / weight.sum(1)
        out = []
        for i, b in enumerate(best):
            lang, low = self.langs[b], float(bits[i, b])
            out.append((lang, float(score[i]), low, bool(self.rejects(lang, low, n[i]))) if letters[i] else ("und", 0.0, 0.0, True))
        return out


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in groups of CHUNK characters, or one longer text alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size + len(t or "") > CHUNK and i > at:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t or "")
    if len(texts) > at:
        yield at, texts[at:]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Identifier:
    """Models and limits from labelled documents: about `sample` of each language for counts and as many for calibration.

    The sample is by a hash of the id, each language's share by its number of documents, so reruns agree. A line counts
    once for a language, however many documents repeat it; n-grams are counted in tasks and summed by key. What reaches the driver is bounded by the sample: counts of n-grams and a number a
    calibration document.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit(5)).alias("h"))
    share = labelled.groupBy("lang").agg(F.count("*").alias("docs")).collect()  # a row for each language, as the models are
    if not share:
        return Identifier({})
    numbers = docs.sparkSession.createDataFrame([(row["lang"], row["docs"]) for row in share], "lang string, docs long")
    labelled, number = labelled.join(F.broadcast(numbers), "lang"), F.col("docs")
    point = F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003.0
    drawn = labelled.withColumn("at", point * number / sample).where("at < 2").withColumn("counted", F.col("at") < F.least(F.lit(1.0), number / sample * 0.7))
    letters = _letters()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}  # bounded as the sample is
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for _, group in _groups(texts):
                    keys, n = np.unique(keys_of(group, letters)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])

    lines = drawn.where("counted").select("lang", F.explode(F.split("text", "\n")).alias("line")).distinct()
    counts = lines.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    by_lang = {}
    for lang, rows in counts.groupby("lang"):
        keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        order = np.argsort(keys)
        by_lang[lang] = keys[order], n[order]
    fitted = Identifier(by_lang)
    if not fitted.langs:
        return fitted
    told = docs.sparkSession.sparkContext.broadcast(fitted.state())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Identifier.of(told.value)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, group in _groups(texts):
                bits, n, letters_of = model.entropies(group)
                best = bits.argmin(1)  # a text that another language fits better may be labelled wrongly and sets no limit
                rows = [(lang, float(bits[i, best[i]]), int(n[i])) for i, lang in enumerate(langs[at : at + len(group)]) if letters_of[i] and lang == model.langs[best[i]]]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.string(), pa.float64(), pa.int64()))], names=["lang", "bits", "n"])

    held = drawn.where("not counted").select("lang", "text").mapInArrow(measure, "lang string, bits double, n long").toPandas()
    for lang, rows in held.groupby("lang"):
        fitted.calibrate(lang, rows["bits"].to_numpy(), rows["n"].to_numpy())
    return fitted


def identify(docs: DataFrame, model: Identifier, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those to keep) with lang_pred, score (0 to 1), bits (a character) and rejected.

    The language whose model has the lowest cross-entropy a character. score weighs the others' distance from it by the
    square root of the text's length. A text is rejected that is further off than its language's calibration texts of about
    its length are (rejects). Null texts and texts without a letter are `und` with score 0 and rejected, as
    are all texts if no language was learned; repeated rows are judged each; an empty table gives an empty one; columns of
    these names are replaced.
    """
    told = docs.sparkSession.sparkContext.broadcast(model.state())

    def make():
        fitted = Identifier.of(told.value)

        def judge(texts: list[str | None]) -> list[pa.Array]:
            rows = [row for _, group in _groups(texts) for row in fitted.predict(group)]
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]

        return judge

    return mapped(docs, text_col, {"lang_pred": "string", "score": "double", "bits": "double", "rejected": "boolean"}, make, keep)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from labelled documents whose fold is not 2 and judge all: doc_id, held_out, lang_pred, score, bits and rejected."""
    model = fit(docs.where(fold(F.col("doc_id")) != 2).select("doc_id", "text", "lang"))
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
