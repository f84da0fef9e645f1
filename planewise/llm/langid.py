"""Language identification: one interpolated Kneser-Ney character model per language.

Text is reduced to lower-case letters with one boundary sign between words.  Each language has
counts of character n-grams of orders 1 to ``ORDER``; the highest order uses its counts, the lower
ones continuation counts (how many characters precede an n-gram), each order discounted and
interpolated with the next lower one.

The models are stored together: per order one sorted array of n-gram hashes with the final
log probability under every language, and one sorted array of context hashes with every language's
log back-off weight, for n-grams no language has seen.  A text gets the language of the lowest cross-entropy
per sign.  It is *rejected* if that is above the language's limit, or if no language was learned.  The limit is
calibrated on one training text in ``CALIBRATION`` that was not counted: the median, plus so many deviations of the mean of
as many signs (spread between texts, ``SPREAD`` nats at least, and within them) as the 99th percentile of these texts shows, ``SLACK`` at least.

Counts are fitted on at most ``most_docs`` documents a language (a documented bound; by hash of the id); the n-gram types of that
sample are what the driver holds and ships.
Contract: null text, or text without a letter, is ``und`` with score 0 and is rejected; a null id
counts like any other; repeated rows are learned and judged each for itself; texts are read whole; extra columns are
ignored (``keep_known`` passes them on); with nothing to learn from every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planewise.llm.common import fold, trimmed
from planewise.llm.textbuf import U64, flatten, mix, slices

ORDER = 4
MOST_DOCS = 4000
#: One training text in so many calibrates the limits and is not counted.
CALIBRATION = 5
#: The least number of deviations a text may lie above its language's median.
SLACK = 6.0
#: The least deviation between long texts of a language: digits of secrets and passages of another language cost clean texts that much.
SPREAD = 0.15
_BASE = 0x9FB21C651E98DF25
_letters: list[np.ndarray] = []


def _alphabet() -> np.ndarray:
    """Code point to its lower-case letter, 0 for anything else."""
    if not _letters:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs, documents): letters, and 0 before the first and after every word, for a slice of texts."""
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=before[1:])
    at = before[off]
    sign = np.zeros(len(points) + len(off) - 1, np.uint32)  # a boundary before each text
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    sign[np.arange(len(points)) + doc + 1] = _alphabet()[points]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at) + 1)
    keep = np.ones(len(sign), bool)
    keep[1:] = (sign[1:] != 0) | (sign[:-1] != 0) | (doc[1:] != doc[:-1])
    return sign[keep], doc[keep]


def grams(sign: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the n-grams of orders 0 to ORDER ending at each place, and of the contexts (0 to ORDER - 1 signs before it).

    None reaches back beyond a word's boundary sign or a document's start: the boundary is repeated there.
    """
    s = sign.astype(U64) + U64(1)
    gram, context = [np.zeros(len(s), U64)], []
    acc, before = np.zeros(len(s), U64), np.zeros(len(s), U64)
    inside = np.ones(len(s), bool)
    boundary = U64(1)
    lagged = s
    for k in range(ORDER):
        taken, power = np.where(inside, lagged, boundary), U64(pow(_BASE, k, 1 << 64))
        context.append(mix(before + _salt(k, 0xA24BAED4963EE407)))
        acc = acc + taken * power
        if k < ORDER - 1:
            lagged = np.full(len(s), boundary, U64)
            lagged[k + 1 :] = s[: len(s) - k - 1]
            same = np.zeros(len(s), bool)
            same[k + 1 :] = doc[k + 1 :] == doc[: len(s) - k - 1]
            inside = inside & same & ((taken != boundary) if k else True)
            before = before + np.where(inside, lagged, boundary) * power
        gram.append(mix(acc + _salt(k, 0xD1B54A32D192ED03)))
    return gram, context


def _salt(k: int, odd: int) -> np.uint64:
    return U64((k + 1) * odd % (1 << 64))


def _first(doc: np.ndarray) -> np.ndarray:
    out = np.ones(len(doc), bool)
    out[1:] = doc[1:] != doc[:-1]
    return out


@dataclass
class Order:
    keys: np.ndarray  # sorted n-gram hashes
    logp: np.ndarray  # (n-grams, languages)
    contexts: np.ndarray  # sorted hashes of the n-grams one order lower
    backoff: np.ndarray  # (contexts, languages)


def find(keys: np.ndarray, index: np.ndarray, shift: int, h: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted array, -1 if absent; ``index`` holds where each prefix starts."""
    if not len(keys):
        return np.full(len(h), -1)
    at = index[(h >> U64(shift)).astype(np.int64)]
    out = np.where(keys[np.minimum(at, len(keys) - 1)] == h, at, -1)
    todo = np.flatnonzero(out < 0)
    at, want = at[todo], h[todo]
    while len(todo):
        at = at + 1
        open_ = at < len(keys)
        todo, at, want = todo[open_], at[open_], want[open_]
        here = keys[at]
        hit = here == want
        out[todo[hit]] = at[hit]
        more = here < want
        todo, at, want = todo[more], at[more], want[more]
    return out


class Models:
    def __init__(self, langs: list[str], orders: list[Order], floor: float):
        self.langs, self.orders, self.floor = langs, orders, floor
        #: Of each language: median, squared spread between texts, variance of a sign, deviations allowed.
        self.limits = np.tile([np.inf, 0.0, 0.0, SLACK], (len(langs), 1))
        self.prepare()

    def prepare(self) -> None:
        self.index = [tuple(self._index(k) for k in (o.keys, o.contexts)) for o in self.orders]

    @staticmethod
    def _index(keys: np.ndarray) -> tuple[np.ndarray, int]:
        bits = max(1, min(20, len(keys).bit_length() + 1))
        return np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << U64(64 - bits)), 64 - bits

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.prepare()

    def logp(self, g: list[np.ndarray], c: list[np.ndarray], order: int = ORDER) -> np.ndarray:
        """Log probability (places, languages) of the last sign of each n-gram given those before it."""
        if not order:
            return np.full((len(g[0]), len(self.langs)), self.floor, np.float32)
        o, (keys, contexts) = self.orders[order - 1], self.index[order - 1]
        at = find(o.keys, *keys, g[order])
        out = o.logp[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            low = self.logp([x[miss] for x in g[:order]], [x[miss] for x in c[:order]], order - 1)
            at = find(o.contexts, *contexts, c[order - 1][miss])
            out[miss] = low + np.where(at[:, None] >= 0, o.backoff[at], 0)
        return out

    def surprise(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log probabilities a sign and language, where each document's signs begin, letters of each document) of a slice."""
        n = len(off) - 1
        sign, doc = symbols(buf, off)
        at = np.flatnonzero(~_first(doc))
        g, c = grams(sign, doc)
        lp = self.logp([x[at] for x in g], [x[at] for x in c])
        letters = np.bincount(doc[at][sign[at] != 0], minlength=n).astype(float)
        return lp, np.searchsorted(doc[at], np.arange(n + 1)), letters

    def entropies(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy a sign in nats under each language, signs, letters) of each document of a slice."""
        lp, edge, letters = self.surprise(buf, off)
        cum = np.zeros((len(lp) + 1, len(self.langs)))
        np.cumsum(lp, axis=0, out=cum[1:])
        count = np.diff(edge)
        return -(cum[edge[1:]] - cum[edge[:-1]]) / np.maximum(count, 1)[:, None], count, letters

    def decide(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, score, accepted)."""
        n = len(off) - 1
        if not self.langs:
            return np.full(n, -1), np.zeros(n), np.zeros(n, bool)
        h, count, letters = self.entropies(buf, off)
        best = np.argmin(h, axis=1)
        gap = h - h[np.arange(n), best][:, None]
        # a posterior as if at most 64 signs were independent evidence
        score = 1 / np.exp(-gap * np.clip(letters, 1, 64)[:, None]).sum(axis=1)
        some = letters > 0
        middle, between, within, slack = self.limits[best].T
        limit = middle + slack * np.sqrt(between + within / np.maximum(count, 1))
        return np.where(some, best, -1), np.where(some, score, 0.0), some & (h[np.arange(n), best] <= limit)


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, context: np.ndarray, suffix: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Models:
    """Models from n-gram types: per row a language, an order (``sizes``), hashes of the n-gram, of its context (all but
    the last sign) and of its suffix (all but the first), and its count."""
    nl = len(langs)
    orders: list[Order] = []
    lower: Order | None = None
    vocabulary = max(2, len(np.unique(gram[sizes == 1])) + 1)
    floor = float(-np.log(vocabulary))
    for k in range(1, ORDER + 1):
        here = sizes == k
        g, c, s, l, n = gram[here], context[here], suffix[here], lang[here], counts[here].astype(float)
        if k < ORDER:  # continuation counts: distinct n-grams of the next order that end in this one
            up = sizes == k + 1
            key = mix(suffix[up]) + lang[up].astype(U64)
            types, cont = np.unique(key, return_counts=True)
            at = np.searchsorted(types, mix(g) + l.astype(U64))
            n = np.where(types[np.minimum(at, len(types) - 1)] == mix(g) + l.astype(U64), cont[np.minimum(at, len(types) - 1)], 1).astype(float)
        keys, gi = np.unique(g, return_inverse=True)
        contexts, ci = np.unique(c, return_inverse=True)
        first = np.unique(gi, return_index=True)[1]
        of, sfx = ci[first], s[first]
        table = np.zeros((len(keys), nl))
        np.add.at(table, (gi, l), n)
        total, kinds = np.zeros((len(contexts), nl)), np.zeros((len(contexts), nl))
        np.add.at(total, (ci, l), n)
        np.add.at(kinds, (ci, l), 1)
        once, twice = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
        discount = np.clip(np.where(once + twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.9)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
        if lower is None:
            below = np.full((len(keys), nl), 1 / vocabulary)
        else:
            at = np.searchsorted(lower.keys, sfx)
            below = np.exp(lower.logp[np.minimum(at, len(lower.keys) - 1)])
        p = np.maximum(table - discount, 0) / np.maximum(total[of], 1e-9) + weight[of] * below
        lower = Order(keys, np.log(np.maximum(p, 1e-12)).astype(np.float32), contexts, np.log(np.maximum(weight, 1e-12)).astype(np.float32))
        orders.append(lower)
    return Models(langs, orders, floor)


def training_docs(docs: DataFrame, most_docs: int, folds: int, held_out: int) -> DataFrame:
    """(lang, text, calibrates) of at most ``most_docs`` documents of each language, the ids of the smallest hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (fold("doc_id", folds) != held_out))
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # rows of hash below a share of about the bound go on; the bound itself is held by rank
    share = F.lit(0.0)
    for name, n in total.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 1.1 * most_docs / n + 10 / n))).otherwise(share)
    h = F.xxhash64(F.lit("lang"), "doc_id")
    rows = rows.where(F.pmod(h, F.lit(1 << 30)) < share * (1 << 30))
    ids = rows.select("lang", "doc_id", h.alias("h")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    last = {r["lang"]: r["h"] for r in ids.where(F.col("rank") == most_docs).collect()}
    for name, edge in last.items():
        rows = rows.where((F.col("lang") != name) | (h <= F.lit(edge)))
    return rows.select("lang", "text", (F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATION)) == 0).alias("calibrates"))


def train(docs: DataFrame, *, most_docs: int = MOST_DOCS, folds: int = 4, held_out: int = 2) -> Models:
    """Count n-grams in Spark, build the models, then calibrate the limits on texts set apart."""
    rows = training_docs(docs, most_docs, folds, held_out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            names = np.array(batch[0].to_pylist(), object)
            buf, off = flatten(batch[1])
            for i, j in slices(off):
                sign, doc = symbols(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                at = np.flatnonzero(~_first(doc))
                g, c = grams(sign, doc)
                for name in set(names[i:j]):
                    mine = at[(names[i:j] == name)[doc[at]]]
                    for k in range(1, ORDER + 1):
                        keys, first, n = np.unique(g[k][mine], return_index=True, return_counts=True)
                        held.setdefault(name, []).append((np.full(len(keys), k), keys, c[k - 1][mine[first]], g[k - 1][mine[first]], n))
            if sum(len(x[1]) for v in held.values() for x in v) > 1 << 21:
                yield from flush(held)
        yield from flush(held)

    def flush(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for name, parts in held.items():
            k, g, c, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, first, inv = np.unique(g, return_index=True, return_inverse=True)
            total = np.bincount(inv, n).astype(np.int64)
            cols = [pa.array([name] * len(keys)), pa.array(k[first].astype(np.int32)), *(pa.array(x[first].view(np.int64)) for x in (g, c, s)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "size", "gram", "context", "suffix", "n"])
        held.clear()

    types = rows.where("not calibrates").mapInArrow(trimmed(count), "lang string, size int, gram long, context long, suffix long, n long")
    table = types.groupBy("lang", "size", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n")).toPandas()
    if not len(table):
        return Models([], [], 0.0)
    table = table.sort_values(["lang", "size", "gram"])
    langs = sorted(table["lang"].unique())
    code = np.searchsorted(langs, table["lang"].to_numpy())
    as_u64 = lambda c: table[c].to_numpy(np.int64).view(U64)
    models = build(langs, code, as_u64("gram"), as_u64("context"), as_u64("suffix"), table["n"].to_numpy(), table["size"].to_numpy())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch[0].to_pylist(), object)
            buf, off = flatten(batch[1])
            for i, j in slices(off):
                lp, edge, letters = models.surprise(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                of = np.repeat(np.arange(j - i), np.diff(edge))
                own = -lp[np.arange(len(lp)), np.searchsorted(langs, names[i:j].astype(str))[of]].astype(float)
                n = np.maximum(np.diff(edge), 1)
                h = np.bincount(of, own, j - i) / n
                within = np.bincount(of, (own - h[of]) ** 2, j - i) / n
                yield pa.RecordBatch.from_arrays([pa.array(names[i:j], pa.string()), *(pa.array(x.astype(float)) for x in (h, within, n, letters))], names=["lang", "h", "within", "n", "letters"])

    # at most most_docs / CALIBRATION rows a language or so; those of a language the counts did not see cannot be measured
    apart = rows.where(F.col("calibrates") & F.col("lang").isin(langs))
    fits = apart.mapInArrow(trimmed(measure), "lang string, h double, within double, n double, letters double").where("letters >= 100").toPandas()
    for name, x in fits.groupby("lang"):
        middle = float(x["h"].median())
        between, within = max(SPREAD, float((x["h"] - middle).abs().median() * 1.4826)) ** 2, float(x["within"].mean())
        z = (x["h"] - middle) / np.sqrt(between + within / x["n"])
        models.limits[langs.index(name)] = middle, between, within, max(SLACK, float(z.quantile(0.99)))
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*models.langs, "und"], object)
        for batch in batches:
            buf, off = flatten(batch[1])
            for i, j in slices(off):
                best, score, good = models.decide(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch[0].slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score), pa.array(good)], names=["doc_id", "lang_pred", "score", "accepted"])

    cols = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    return docs.select(*cols).mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double, accepted boolean")


def keep_known(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted; a map, no shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = flatten(batch[place])
            mask = [models.decide(buf[off[i] : off[j]], off[i : j + 1] - off[i])[2] for i, j in slices(off)]
            if mask:
                yield batch.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(trimmed(run), docs.schema)
