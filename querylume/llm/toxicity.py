"""Toxicity by noisy-channel deobfuscation and a learned lexicon.

Scoring restores a text first: a token that is not plainly a word (digits or signs among letters, letters repeated,
single letters spaced out) becomes a lattice of the characters it may stand for, and a Viterbi search finds the most
likely reading under a character trigram model, whatever the token's length; no state of the search is left out. Restored
words are then held against a lexicon of whole words and word beginnings, each with the log ratio of its rates in toxic
and clean documents. Evidence counts by occurrence: how many tokens of the document are in the lexicon, how many that is
beside its length, the best and the summed weights of its tokens go into a logistic model, which gives a probability. So a
beginning that clean documents hold once, and toxic ones again and again, tells them apart.

All models are learned from all labelled training rows. Rows equal in text and label count once, so that copies aren't
evidence; no other row is left out: counts of words, word beginnings and character trigrams are summed by Spark; the lexicon
takes what is significantly more often, once or at least twice, in toxic rows. What too few toxic rows have for that is
never counted in clean ones. The logistic model is fitted to EVIDENCE numbers a row, of which only sums over all rows come
to the driver, in whole units, so that their order doesn't matter. What the driver and the workers hold whole are the models:
they grow with the vocabulary of toxic rows, not with rows. Scoring is one map over the documents, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Container, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylume.llm.common import drop_frozen, freeze, table, tidy

THRESHOLD = 0.7
PREFIXES = range(4, 10)
#: Nats by which the toxic share among the rows that have a feature, once or twice, must exceed chance.
SIGNIFICANCE = 20.0
#: Weight of the logistic model's penalty on squares.
RIDGE = 1.0
EVIDENCE = ("any", "best", "best_squared", "sum", "log_hits", "log_per_100", "length_if_any")
_CACHE_TOKENS = 100_000
#: What a sign may stand for besides itself. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
}
_WILD = "*#"
_GAPS = " .-_~'*·/\\"
_SUBSTITUTED, _KEPT_SIGN, _WILD_COST, _DROPPED, _DROPPED_INNER, _SPLIT, _SPLIT_SPACED, _SQUEEZED = -0.7, -6.0, -1.0, -0.4, -5.0, -1.5, -3.5, -0.5
_LOOKALIKE = frozenset(c for c in LEET if c.isalpha())
_GAP = re.compile("[%s]+" % re.escape(_GAPS))
_EDGES = ".,;:!?\"'()[]{}<>%&$#*@-_|/\\=+~^`…«»„“”’"
_REPEATED = re.compile(r"(\w)\1\1|(\w)\2\w*(\w)\3")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ \t][^\s])+(?!\S)|(?<!\S)[@$!|](?:[ \t]\S){2,}(?!\S)")
#: Two single letters or signs side by side, as in all that _SPACED finds behind a blank.
_PAIR = re.compile(r"\s\S[ \t]\S(?!\S)")
_LETTERS = re.compile(r"[^\W\d_]+")
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\xad]+")


class CharModel:
    """Trigrams of characters within words, '^' before and '$' behind, with additive smoothing over two letters."""

    def __init__(self, trigrams: dict[str, int]):
        self.tri, self.bi, self.letters = trigrams, Counter(), set()
        for t, n in trigrams.items():
            self.bi[t[:2]] += n
            self.letters.add(t[2])
        self.size = max(2, len(self.letters))
        self.known: dict[str, float] = {}

    def log_p(self, two: str, c: str) -> float:
        found = self.known.get(key := two + c)
        if found is None:
            found = self.known[key] = math.log((self.tri.get(key, 0) + 0.05) / (self.bi.get(two, 0) + 0.05 * self.size))
        return found


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each position the strings that it may stand for and their channel costs."""
    out: list[list[tuple[str, float]]] = []
    i, split = 0, _SPLIT_SPACED if max(map(len, _GAP.split(token))) <= 1 else _SPLIT
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        run, inner = j - i, 0 < i and j < len(token)
        if c.isalpha() and c not in LEET:
            out.append([(c, 0.0 if run == 1 else _SQUEEZED)] + ([(c * 2, 0.0 if run == 2 else _SQUEEZED)] if run > 1 else []))
        elif c in LEET:
            ways = [(x, _SUBSTITUTED) for x in LEET[c]] + ([(x * 2, _SUBSTITUTED) for x in LEET[c]] if run > 1 else [])
            ways.append((c, 0.0 if c.isalpha() else _KEPT_SIGN))
            if not c.isalnum():
                ways.append(("", _DROPPED if j == len(token) else _DROPPED_INNER))
            out.append(ways)
        elif c in _WILD and inner:
            for k in range(run):  # each masked letter has a place; a line feed is a split that costs nothing behind another
                out.append([("", _DROPPED_INNER), ("\n" if k else " ", split if run == 1 else _SPLIT), *((x, _WILD_COST) for x in "aeioubcdfghklmnprstvwy")])
        elif c in _GAPS or c in _WILD:
            out.append([("", _DROPPED), (" ", split if run == 1 else _SPLIT)])
        else:
            out.append([(" ", 0.0)])
        i = j
    return out


def restore(token: str, model: CharModel) -> str:
    """The most likely reading of a token of any length: Viterbi over all states of two characters. Each state keeps a link
    to what it was reached by, so that time grows with the length, and dead paths free themselves."""
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for ways in readings(token):
        nxt: dict[str, tuple[float, tuple | None]] = {}
        for two, (cost, link) in states.items():
            for what, extra in ways:
                at, score = two, cost + extra
                for c in what:
                    if c in " \n":
                        if c == "\n" and at == "^^":
                            score -= extra
                        if at != "^^":
                            score, at = score + model.log_p(at, "$"), "^^"
                    else:
                        score += model.log_p(at, c)
                        at = at[1] + c
                if at not in nxt or score > nxt[at][0]:
                    nxt[at] = (score, (link, what) if what else link)
        states = nxt
    link = max((cost + (model.log_p(at, "$") if at != "^^" else 0.0), at, link) for at, (cost, link) in states.items())[2]
    parts: list[str] = []
    while link is not None:
        link, what = link
        parts.append(what)
    return "".join(reversed(parts))


def _tokens(text: str) -> set[str]:
    return set((text if text.isascii() else _INVISIBLE.sub("", text)).lower().split())


def words_of(token: str, model: CharModel | None) -> list[str]:
    """The words of a token: its letters, and if it is suspicious and there is a model, also its restored reading."""
    bare = token.strip(_EDGES)
    if bare.isalpha() and (model is None or not (len(set(bare)) < len(bare) - 1 and _REPEATED.search(bare) or token[0] in LEET or not _LOOKALIKE.isdisjoint(bare))):
        return [bare]
    words = _LETTERS.findall(token)
    if model is not None:
        piece = token.strip(".,;:?\"'()[]{}%&#*~")
        if any(c.isalpha() for c in piece):
            words += restore(piece, model).split()
    return words


def features(word: str) -> list[str]:
    """The word itself ('=') and its beginnings ('^')."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if k <= len(word))] if len(word) > 1 else []


#: Features and tokens that a worker holds before it passes their counts on.
_HELD = 300_000
_COUNTS = "kind string, key string, n long, n_2 long, n_all long"
_COUNT_FIELDS = pa.schema([("kind", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("n_2", pa.int64()), ("n_all", pa.int64())])


def _wanted(word: str, wanted: Container[str] | None) -> list[str]:
    """The features of a word that are wanted. With a longer one that begins with it, a beginning is wanted too."""
    if wanted is None:
        return features(word)
    out = []
    for k in PREFIXES:
        if k > len(word) or (f := "^" + word[:k]) not in wanted:
            break
        out.append(f)
    if (out or 1 < len(word) < PREFIXES[0]) and "=" + word in wanted:
        out.append("=" + word)
    return out


def _trigrams(words: list[str], times: list[int]) -> tuple[list[str], list[int]]:
    """The trigrams of words that occur so many times."""
    x = np.frombuffer("".join([f"^^{w}$" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    times = np.repeat(times, [len(w) + 3 for w in words])
    begins = np.flatnonzero((x[:-2] != ord("$")) & (x[1:-1] != ord("$"))) if words else np.zeros(0, int)
    codes, which = np.unique(x[begins] << np.uint64(42) | x[begins + 1] << np.uint64(21) | x[begins + 2], return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, which, times[begins])
    low = (1 << 21) - 1
    return [chr(c >> 42) + chr(c >> 21 & low) + chr(c & low) for c in codes.tolist()], n.tolist()


def _count_rows(texts: Iterator[str], wanted: Container[str] | None) -> Iterator[tuple[str, list[str], list[list[int]]]]:
    """For each feature, or each that is wanted, the rows that have it, those that have it in two tokens or more, and the
    tokens that have it; for each trigram how often it is; and as a feature without a name all tokens."""
    once, twice, seen = Counter(), Counter(), Counter()
    known: dict[str, list[str]] = {}

    def flush() -> Iterator[tuple[str, list[str], list[list[int]]]]:
        every = Counter(chain.from_iterable([known[token] for token, n in seen.items() if n == 1]))
        for token, n in seen.items():
            if n > 1:
                for f in known[token]:
                    every[f] += n
        every[""] = seen.total()
        keys = list(every)
        yield "f", keys, [[c[k] for k in keys] for c in (once, twice, every)]
        parts = [(w, n) for token, n in seen.items() for w in words_of(token, None)]
        keys, times = _trigrams([w for w, _ in parts], [n for _, n in parts])
        yield "t", keys, [times, [0] * len(keys), [0] * len(keys)]
        for c in (once, twice, seen, known):
            c.clear()

    for text in texts:
        if len(once) + len(seen) > _HELD:
            yield from flush()
        tokens = _tokens(text)
        seen.update(tokens)
        for token in tokens:
            if token not in known:
                words = words_of(token, None)
                known[token] = _wanted(words[0], wanted) if len(words) == 1 else list({f for w in words for f in _wanted(w, wanted)})
        found = Counter(chain.from_iterable([known[token] for token in tokens]))
        once.update(found.keys())
        twice.update([f for f, n in found.items() if n > 1])
    yield from flush()


def _count(wanted: Container[str] | None = None):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t.as_py() for batch in batches for t in batch.column("text"))
        for kind, keys, columns in _count_rows(texts, wanted):
            found = pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), pa.array(keys, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], schema=_COUNT_FIELDS)
            for at in range(0, len(keys), 50_000):
                yield found.slice(at, 50_000)

    return run


def excess(toxic: float, clean: float, share: float) -> float:
    """n times the divergence of the observed toxic share from the base share; 0 if it is not above it."""
    n = toxic + clean
    p = toxic / n if n else 0.0
    if p <= share:
        return 0.0
    return toxic * math.log(p / share) + (clean * math.log((1 - p) / (1 - share)) if clean else 0.0)


class Lexicon:
    """Weights of features, the character model, and the logistic model over a document's evidence: the odds are those of
    ``base`` plus the evidence times ``slopes``. A document without any feature never gets a probability above one half."""

    def __init__(self, weights: dict[str, float], model: CharModel, base: float = 0.0, slopes: dict[str, float] | None = None):
        self.weights, self.model, self.base, self.slopes = weights, model, base, slopes or {"sum": 1.0}
        self.heads = {f[1 : 1 + PREFIXES[0]] for f in weights}

    def weight(self, words: list[str]) -> float:
        """The best weight of a token's words. A word whose first letters begin no feature has none."""
        best = 0.0
        for w in words:
            if w[: PREFIXES[0]] in self.heads:
                best = max([best, *[self.weights[f] for f in features(w) if f in self.weights]])
        return best

    def weights_of(self, text: str, known: dict[str, float]) -> tuple[list[float], int]:
        """Weights of the tokens that have any, and the number of tokens. ``known`` keeps weights from text to text."""
        found, tokens = [], _tokens(text)
        for token in tokens:
            w = known.get(token)
            if w is None:
                if len(known) > _CACHE_TOKENS:
                    known.clear()
                w = known[token] = self.weight(words_of(token, self.model))
            if w:
                found.append(w)
        for m in _SPACED.finditer(lower) if _PAIR.search(" " + (lower := text.lower())) else ():
            if len(piece := m.group()) >= 5:
                found += [w for one in set(restore(piece, self.model).split()) if (w := self.weight([one]))]
        return found, len(tokens)

    def probability(self, text: str | None, known: dict[str, float]) -> float:
        seen = evidence(*self.weights_of(text, known)) if text else evidence([], 0)
        odds = self.base + math.fsum(seen[name] * slope for name, slope in self.slopes.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0 if seen["any"] else 0.0, odds))))


def evidence(found: list[float], n_tokens: int) -> dict[str, float]:
    """What the logistic model sees of a document, from its tokens' weights and their number."""
    hits = len(found)
    return {
        "any": float(hits > 0), "best": max(found, default=0.0), "best_squared": max(found, default=0.0) ** 2, "sum": min(math.fsum(found), 40.0), "log_hits": math.log1p(hits),
        "log_per_100": math.log1p(100 * hits / max(n_tokens, hits, 1)), "length_if_any": math.log1p(n_tokens) if hits else 0.0,
    }


def _seen(lexicon: Lexicon):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            rows = [evidence(*lexicon.weights_of(t.as_py(), known)) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], pa.float64()) for c in EVIDENCE} | {"label": batch.column("_label")})

    return run


#: Sums are of whole multiples of one over this.
_UNIT = 2.0**36


def _totals(seen: DataFrame, values: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows, ``n`` times each, of the columns that ``values`` makes of evidence and labels: the same whatever the
    order of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in EVIDENCE])
            units = np.rint(values(x, batch.column("label").to_numpy()) * _UNIT).astype(np.int64)
            n = batch.column("n").to_numpy()
            halves = [pa.array(n @ h) for h in (units >> 31, units & (1 << 31) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(units.shape[1], dtype=np.int32)), *halves], ["i", "high", "low"])

    found = seen.mapInArrow(run, "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return np.array([((r["high"] << 31) + r["low"]) / _UNIT for r in sorted(found.collect(), key=lambda r: r["i"])])


def fit(seen: DataFrame, ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """Intercept and slopes of a logistic model with a penalty, on standardised columns, by Newton's method. Each step is one
    pass over all rows of EVIDENCE, label and n."""
    total = seen.agg(F.sum("n")).first()[0]
    middle = _totals(seen, lambda x, _: x) / total
    scale = np.maximum(np.sqrt(_totals(seen, lambda x, _: (x - middle) ** 2) / total), 1e-9)
    w = np.zeros(1 + len(EVIDENCE))
    upper = np.triu_indices(len(w))

    def moments(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(x)), (x - middle) / scale])
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return np.column_stack([x * (labels - p)[:, None], x[:, upper[0]] * x[:, upper[1]] * (p * (1 - p))[:, None]])

    for _ in range(50):
        sums = _totals(seen, moments)
        curve = np.zeros((len(w), len(w)))
        curve[upper] = curve.T[upper] = sums[len(w) :]
        step = np.linalg.solve(curve + ridge * np.eye(len(w)), sums[: len(w)] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / scale
    return float(w[0] - slopes @ middle), slopes


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """text, _label: the labelled texts of the training folds, once each. Of equal texts one id is chosen by their hashes, so
    that texts are shuffled once."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isNotNull() & ~held_out(F.col("_id")))
    marks = marks.groupBy("_id").agg(F.max("_label").alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & ~held_out(F.col("_id")))
    texts = texts.withColumn("_hash", F.sha2("text", 256))
    chosen = texts.select("_id", "_hash").join(marks, "_id").groupBy("_hash", "_label").agg(F.min("_id").alias("_id"))
    return texts.join(chosen, ["_id", "_hash"]).dropDuplicates(["_id", "_hash"]).select("text", "_label")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learns from all labelled rows of the training folds: crc32 of the id as text mod 3 is not 1."""
    rows = freeze(_training_rows(docs, labels, id_col, text_col, label_col), "toxicity-rows")
    total, toxic_n = rows.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if not 0 < toxic_n < total:  # nothing to tell apart
        drop_frozen(rows)
        return Lexicon({}, CharModel({}))
    share = toxic_n / total
    least = max(3, math.ceil(SIGNIFICANCE / -math.log(share)))
    sums = [F.sum(c).alias(c) for c in ("n", "n_2", "n_all")]
    toxic = freeze(rows.where("_label <> 0").mapInArrow(_count(), _COUNTS).groupBy("kind", "key").agg(*sums).where(f"kind = 't' or key = '' or n >= {least}"), "toxicity-counts")
    in_toxic = {r["key"]: r for r in toxic.where("kind = 'f'").collect()}
    clean = freeze(rows.where("_label = 0").mapInArrow(_count(frozenset(in_toxic)), _COUNTS).groupBy("kind", "key").agg(*sums), "toxicity-counts")
    in_clean = {r["key"]: r for r in clean.where("kind = 'f'").collect()}
    model = CharModel({r["key"]: r["n"] for r in toxic.union(clean).where("kind = 't'").groupBy("key").agg(F.sum("n").alias("n")).collect()})
    none = {"n": 0, "n_2": 0, "n_all": 0}
    toxic_all, clean_all = (x.get("", none)["n_all"] for x in (in_toxic, in_clean))
    weights = {}
    for key, t in in_toxic.items():
        c = in_clean.get(key, none)
        rate = math.log((t["n_all"] + 0.5) / (toxic_all + 1)) - math.log((c["n_all"] + 0.5) / (clean_all + 1))
        if key and rate > 0 and max(excess(t["n"], c["n"], share), excess(t["n_2"], c["n_2"], share)) >= SIGNIFICANCE:
            weights[key] = rate
    seen = rows.mapInArrow(_seen(Lexicon(weights, model)), ", ".join(f"{c} double" for c in EVIDENCE) + ", label int")
    seen = freeze(seen.groupBy(*EVIDENCE, "label").agg(F.count("*").alias("n")), "toxicity-evidence")
    base, slopes = fit(seen)
    drop_frozen(rows, toxic, clean, seen)
    return Lexicon(weights, model, base, dict(zip(EVIDENCE, slopes.tolist())))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _scores(lexicon: Lexicon, text_col: str = "text", below: float | None = None):
    """Adds a score for the text, or with ``below``, keeps the rows that score below it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores = np.array([lexicon.probability(t.as_py(), known) for t in batch.column(text_col)], np.float64)
            if below is None:
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(scores)})
            else:
                yield batch.filter(pa.array(scores < below))

    return run


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, score, predicted.

    Null and empty texts get the score of a text without any lexicon word. Equal texts get equal scores. A null id is
    of the training folds. Other columns are ignored. Without labels every score is below the threshold."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scores(lexicon), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    Every row is judged by its own text: rows with one id may stay and go, rows that repeat stay or go together, and null
    and empty texts stay. Without labels all rows stay. Columns may have any names. An empty table gives an empty result."""
    return docs.mapInArrow(_scores(learn(docs, labels, id_col, text_col), text_col, THRESHOLD), docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores all ``documents``: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
