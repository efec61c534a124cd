"""Language-model scores: a log-bilinear model, class then group then word, trained with noise-contrastive estimation in numpy.

Every training token counts: token counts are added up in tasks, combined by token, and stay a distributed table. The
WORDS most frequent tokens and the end are classes of their own; any other token belongs to one of TAILS classes by its
last two bytes. In a tail class the tokens of the head stand in groups of GROUP by frequency, and all others in one last
group, the rest. With w the two tokens before,

    P(token | w) = P(class | w) * P(group | class, w) * P(token | group, w)

where the class and each group and head token has an output vector and a bias. The last two factors are 1 for classes of one
token; in the rest the last is (c + 0.5) / (N + 0.5 * (V + 1)), c the token's training count, N and V the tokens and
distinct tokens of the rest, and one place is left for unseen ones. A token before counts with the vector of its class and,
in the head, one of its own, weighted by position. Each factor is normalised over its choices.

Training runs in every task over all its training texts, from the same start; the tasks' weights are averaged by their
tokens, rows of words and groups by the steps that reached them. Counts of the HEAD most frequent tokens travel with the model, whose size is fixed; for the others the texts'
tokens are joined with the count table, so no table that grows with the corpus is sent to a task or to the driver.

Defined cases: null text counts as empty and consists of the end alone; without training rows all counts are zero; a
null id is neither held out nor learned from; equal rows are scored each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import held_out, learnable
from tallyloom.session import cut_lineage

WORDS = 63
TAILS = 64
GROUP = 64
HEAD = 65_536
SIZE = 16
NOISE = 32
#: Noise words for a token inside its class and its group; batches of classes that make one step of the words and of all vectors before a token.
INSIDE_NOISE = 2
INSIDE_BATCHES = 8
BATCH = 1024
LEAST_BATCH = 64
STEPS = 256
RATE = 0.15
SEED = 7
#: Distinct tokens a task gathers before it hands their counts on; tokens learned from at once; contexts normalised at once.
FLUSH = 400_000
#: Bytes of text that are split and scored at once, if no single text is longer.
SLICE = 1 << 21
PIECE = 400_000
CONTEXTS = 1024
#: Scores whose exponentials are summed as they are, far from what 32 bits hold.
SAFE = 60.0
#: The end of a text; no word is empty.
END = b""


def tail(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % TAILS


def text_slices(texts: pa.Array) -> Iterator[slice]:
    """The rows in runs of about SLICE bytes of text, one row at least each."""
    part = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(texts)]
    for first, last in zip(cuts[:-1], cuts[1:]):
        if last > first:
            yield slice(first, last)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as bytes, in order, and the number of the first word of each text, closed by the number of all."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten().cast(pa.binary())
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full, min_count=0).as_py():  # beside white space at either end of a text
        bounds = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[bounds]
        words = words.filter(full)
    return words, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0

    def merged() -> pa.Table:
        table = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")])
        return table.select(["token", "n_sum"]).rename_columns(["token", "n"])

    for batch in batches:
        texts = batch.column("text")
        for part in text_slices(texts):
            words, _ = words_of(texts[part])
            counted = pc.value_counts(words)
            held.append(pa.table({"token": counted.field(0), "n": counted.field(1)}))
            held.append(pa.table({"token": pa.array([END], pa.binary()), "n": pa.array([part.stop - part.start], pa.int64())}))
            size += len(counted) + 1
            if size >= FLUSH:
                held = [merged()]
                size = len(held[0])
                if 2 * size >= FLUSH:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from merged().to_batches()


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token binary, n) over all rows of ``docs``, written to the shared folder."""
    return cut_lineage(docs.select("text").mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place of ``x``."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def chosen(scores: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Log probability of one choice a row by softmax; ``scores`` is overwritten."""
    own = scores[np.arange(len(scores)), choice]
    if -SAFE < scores.min() and scores.max() < SAFE:  # no row can overflow or vanish
        top = 0.0
    else:
        top = scores.max(axis=1)
        scores -= top[:, None]
    np.exp(scores, out=scores)
    return own - top - np.log(scores @ np.ones(scores.shape[1], scores.dtype))


@dataclass
class Level:
    """Choices first[p] to first[p + 1] belong to parent p; ``mass`` is by choice."""

    first: np.ndarray
    mass: np.ndarray

    def __post_init__(self):
        self.edges = np.concatenate([[0.0], np.cumsum(self.mass)])
        parent = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.prior = np.log(self.mass / np.bincount(parent, weights=self.mass, minlength=len(self.first) - 1)[parent])

    def start(self) -> np.ndarray:
        """Weights of each choice, its bias last: no vector, the log of its share."""
        return np.concatenate([np.zeros((len(self.mass), SIZE)), self.prior[:, None]], axis=1).astype(np.float32)

    def noise(self, parent: np.ndarray, u: np.ndarray) -> np.ndarray:
        low, high = self.first[parent][:, None], self.first[parent + 1][:, None]
        drawn = np.searchsorted(self.edges, self.edges[low] + u * (self.edges[high] - self.edges[low]), side="right") - 1
        return np.clip(drawn, low, high - 1)

    def log(self, weights: np.ndarray, vector: np.ndarray, parent: np.ndarray, choice: np.ndarray) -> np.ndarray:
        """Normalised log probability of each choice among those of its parent."""
        order = np.argsort(parent.astype(np.uint16), kind="stable")  # fewer than 2^16 parents, which sorts by digits
        cuts = np.append(np.nonzero(np.diff(parent[order], prepend=-1))[0], len(order))
        result = np.empty(len(parent))
        for a, b in zip(cuts[:-1], cuts[1:]):
            low, high = self.first[parent[order[a]]], self.first[parent[order[a]] + 1]
            out, bias = np.ascontiguousarray(weights[low:high, :SIZE].T), weights[low:high, SIZE]
            for at in range(a, b, CONTEXTS):
                rows = order[at : min(b, at + CONTEXTS)]
                result[rows] = chosen(vector.take(rows, axis=0) @ out + bias, choice[rows] - low)
        return result


@dataclass
class Model:
    """Class c < own is the c-th head token; the others are tail classes. ``bias``, ``out`` and ``into`` are by class.

    Head tokens from ``own`` on are words: ``item`` is their place in the order by group, in which ``words`` is kept;
    ``word_into`` is by word. A place is a class, nothing (``classes``), or a word behind these.
    """

    head: dict[bytes, int]
    head_count: np.ndarray
    head_class: np.ndarray
    own: int
    class_total: np.ndarray  # log10(N_class + 0.5 * (V_class + 1)) of tail classes, 0 of the others
    share: np.ndarray
    total: int
    distinct: int
    into: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    place: np.ndarray
    item: np.ndarray
    group_of: np.ndarray
    by_class: Level
    by_group: Level
    groups: np.ndarray
    words: np.ndarray
    word_into: np.ndarray

    @property
    def place_class(self) -> np.ndarray:
        return np.concatenate([np.arange(self.classes + 1), self.head_class[self.own :]])

    @property
    def classes(self) -> int:
        return len(self.bias)

    def codes(self, words: pa.Array | list[bytes]) -> np.ndarray:
        """Number in the head, or -1 - tail class for other tokens."""
        words = pa.array(words, pa.binary())
        codes = pc.index_in(words, value_set=pa.array(list(self.head), pa.binary())).fill_null(-1).to_numpy().astype(np.int64)
        other = np.nonzero(codes < 0)[0]
        ends = pc.binary_slice(words.take(pa.array(other)), start=-2).dictionary_encode()  # few distinct ones
        tails = np.array([-1 - tail(token) for token in ends.dictionary.to_pylist()], dtype=np.int64)
        codes[other] = tails.take(ends.indices.to_numpy()) if len(other) else 0
        return codes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Codes of all tokens of the texts and where each text starts; its words and their bounds, without the ends."""
        words, bounds = words_of(texts)
        ends = np.zeros(len(words) + len(texts), dtype=bool)
        ends[bounds[1:] + np.arange(len(texts))] = True
        codes = np.zeros(len(ends), dtype=np.int64)  # the end is the first of the head
        codes[~ends] = self.codes(words)
        return codes, bounds[:-1] + np.arange(len(texts)), words, bounds

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.head_class[np.maximum(codes, 0)], self.own - 1 - codes)

    def places(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= self.own, codes - self.own + self.classes + 1, self.class_of(codes))

    def inside(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tail class and group of codes in tail classes, and the place of words among the words, -1 for others."""
        parent = self.class_of(codes) - self.own
        item = np.full(len(codes), -1)
        item[codes >= 0] = self.item[codes[codes >= 0] - self.own]
        group = self.by_class.first[parent + 1] - 1
        group[item >= 0] = self.group_of[item[item >= 0]]
        return parent, group, item

    def contexts(self, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes (or places) one and two before; ``classes`` stands for nothing before a start."""
        one = np.concatenate([[self.classes], classes[:-1]])
        one[starts] = self.classes
        two = np.concatenate([[self.classes], one[:-1]])
        two[starts] = self.classes
        return one, two

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """What each place adds to the context as the token before, and as the one before that."""
        vector = embed(vars(self), self.place_class, np.arange(len(self.place_class)))
        return vector * self.place[0], vector * self.place[1]

    def log10(self, classes: np.ndarray, starts: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """Normalised log10 probability of each class given the two places (classes, if there are none) before it."""
        one, two = self.contexts(classes if places is None else places, starts)
        first, second = self.before()
        out = np.ascontiguousarray(self.out.T)
        result = np.empty(len(classes))
        for a in range(0, len(classes), CONTEXTS):
            part = slice(a, a + CONTEXTS)
            vector = first.take(one[part], axis=0) + second.take(two[part], axis=0)
            result[part] = chosen(vector @ out + self.bias, classes[part])
        return result / math.log(10)

    def log10_inside(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token in its class; of the rest's tokens without log10(c + 0.5)."""
        one, two = self.contexts(self.places(codes), starts)
        result = np.zeros(len(codes))
        at = np.nonzero((codes < 0) | (codes >= self.own))[0]
        first, second = self.before()
        vector = first.take(one[at], axis=0) + second.take(two[at], axis=0)
        parent, group, item = self.inside(codes[at])
        result[at] = self.by_class.log(self.groups, vector, parent, group)
        word = item >= 0
        result[at[word]] += self.by_group.log(self.words, vector[word], group[word], item[word])
        result[at[~word]] -= np.log(self.by_class.mass[group[~word]])
        return result / math.log(10)


def embed(weights: dict[str, np.ndarray], place_class: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Vectors of places before a token: of the class, and the word's own."""
    vector = weights["into"].take(place_class.take(places), axis=0)
    words = places - len(weights["into"])
    own = np.nonzero(words >= 0)[0]
    vector[own] += weights["word_into"].take(words[own], axis=0)
    return vector


def head_of(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The end, a class in any case, and up to HEAD of the most frequent tokens, most frequent first.

    Counts are binned by their logarithm; bins that fit as a whole are fetched, and of the one that does not, as many as
    there is room for by count and token, so no task offers more than HEAD and ties at the edge go to the token that sorts first.
    """
    level = F.floor(F.log2("n") * 64)
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size")).collect()
    room, least, crossing = HEAD, None, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if r["size"] > room:
            crossing = r["level"]
            break
        room -= r["size"]
        least = r["level"]
    rows = [] if least is None else counts.filter(level >= least).collect()
    if crossing is not None and room:
        rows += counts.filter(level == crossing).orderBy(F.desc("n"), "token").limit(room).collect()
    ranked = sorted(((bytes(r["token"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))
    end = counts.filter(F.col("token") == END).first()
    return [(END, end["n"] if end else 0), *(x for x in ranked if x[0] != END)]


def untrained(counts: DataFrame) -> Model:
    """Classes and totals from the count table; the weights start as the plain class frequencies."""
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = head_of(counts)
    own = min(len(top), WORDS + 1)
    last = F.expr("substring(token, greatest(length(token) - 1, 1), 2)")
    tails = counts.groupBy((F.crc32(last) % TAILS).alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = np.zeros(TAILS), np.zeros(TAILS)
    for r in tails:
        n[r["tail"]], v[r["tail"]] = r["n"], r["v"]
    for token, count in top[:own]:
        n[tail(token)] -= count
        v[tail(token)] -= count > 0
    head = {token: i for i, (token, _) in enumerate(top)}
    head_class = np.array([i if i < own else own + tail(token) for i, (token, _) in enumerate(top)])
    head_count = np.array([count for _, count in top], dtype=float)
    share = np.concatenate([head_count[:own], n]) + 0.5
    share /= share.sum()
    rng = np.random.default_rng(SEED)
    k = own + TAILS
    member, count = head_class[own:] - own, head_count[own:]
    sizes = np.bincount(member, minlength=TAILS)
    first_group = np.concatenate([[0], np.cumsum(-(-sizes // GROUP) + 1)])
    order = np.argsort(member, kind="stable")
    within = np.arange(len(member)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    group_of = first_group[member[order]] + within // GROUP
    item = np.empty(len(member), dtype=np.int64)
    item[order] = np.arange(len(member))
    mass = count[order] + 0.5
    group_mass = np.bincount(group_of, weights=mass, minlength=first_group[-1]).astype(float)  # of nothing it counts in integers
    rest = n - np.bincount(member, weights=count, minlength=TAILS) + 0.5 * (v - sizes + 1)
    group_mass[first_group[1:] - 1] = rest
    by_class, by_group = Level(first_group, group_mass), Level(np.searchsorted(group_of, np.arange(first_group[-1] + 1)), mass)
    return Model(
        head, head_count, head_class, own, np.concatenate([np.zeros(own), np.log10(n + 0.5 * (v + 1))]), share, int(sums["n"] or 0), int(sums["v"]),
        rng.normal(0, 0.1, (k + 1, SIZE)).astype(np.float32), rng.normal(0, 0.1, (k, SIZE)).astype(np.float32),
        np.log(share).astype(np.float32), np.array([[1.0] * SIZE, [0.5] * SIZE], dtype=np.float32),
        item, group_of, by_class, by_group, by_class.start(), by_group.start(), np.zeros((len(member), SIZE), dtype=np.float32),
    )


DENSE = ("into", "out", "bias", "place")
ROWS = ("groups", "words", "word_into")


class Trainer:
    """Adagrad steps of noise-contrastive estimation; the noise is the class frequency, drawn once for each batch.

    Rows of single words and groups take the sums of their gradients, as few tokens of a batch reach them, all else the means.
    """

    def __init__(self, model: Model):
        self.m = model
        self.weights = {"into": model.into.copy(), "out": model.out.copy(), "bias": model.bias.copy(), "place": model.place.copy()}
        self.weights |= {k: getattr(model, k).copy() for k in ROWS}
        self.touched = {k: np.zeros(len(self.weights[k])) for k in ROWS}
        self.place_class = model.place_class
        self.squares = {k: np.full_like(w, 1e-2) for k, w in self.weights.items()}
        self.rng = np.random.default_rng(SEED)
        self.log_noise = np.log(NOISE * model.share).astype(np.float32)
        self.edges = np.cumsum(model.share)
        self.seen = 0

    def _apply(self, name: str, grad: np.ndarray) -> None:
        self.squares[name] += grad * grad
        self.weights[name] -= RATE * grad / np.sqrt(self.squares[name])

    def _rows(self, name: str, at: np.ndarray, grads: Iterable[np.ndarray]) -> None:
        times = np.bincount(at, minlength=len(self.touched[name]))
        rows = np.nonzero(times)[0]
        number = np.empty(len(times), dtype=np.int64)
        number[rows] = np.arange(len(rows))
        grad = self._scatter(number.take(at), grads, len(rows))
        self.touched[name] += times
        squares = self.squares[name].take(rows, axis=0) + grad * grad
        self.squares[name][rows] = squares
        self.weights[name][rows] -= RATE * grad / np.sqrt(squares)

    def _before(self, one: np.ndarray, two: np.ndarray, d_context: np.ndarray) -> None:
        """Gradients reach the vectors of what stood before: their mean those of classes, their sum those of words."""
        at = np.concatenate([one, two])
        words = at - len(self.weights["into"])
        own = np.nonzero(words >= 0)[0]
        columns = list(self._both(d_context))
        if len(own):
            self._rows("word_into", words[own], (x.take(own) for x in columns))
        self._apply("into", self._scatter(self.place_class.take(at), columns, len(self.weights["into"])) / len(one))

    def _both(self, d_context: np.ndarray) -> Iterator[np.ndarray]:
        """By column, the gradients of what stood before and then of what stood before that."""
        for d, place in zip(np.ascontiguousarray(d_context.T), self.weights["place"].T):
            yield np.concatenate([d * place[0], d * place[1]])

    @staticmethod
    def _scatter(at: np.ndarray, columns: Iterable[np.ndarray], size: int) -> np.ndarray:
        """Sums by number, a column at a time, so that nothing as large as all rows is made."""
        return np.stack([np.bincount(at, weights=column, minlength=size).astype(np.float32) for column in columns], axis=1)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """One step of the class level; the gradient of each token's context, not divided by their number."""
        out, bias, place = (self.weights[k] for k in ("out", "bias", "place"))
        k, b = len(bias), len(target)
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), k - 1)
        e1, e2 = embed(self.weights, self.place_class, one), embed(self.weights, self.place_class, two)
        context = e1 * place[0] + e2 * place[1]
        true = out[target]
        s_true = np.einsum("ij,ij->i", context, true) + bias[target] - self.log_noise[target]
        s_noise = context @ out[noise].T + (bias[noise] - self.log_noise[noise])
        g_true = (sigmoid(s_true) - 1) / b
        g_noise = sigmoid(s_noise)
        g_noise /= b
        d_context = g_true[:, None] * true + g_noise @ out[noise]
        flat = (target[:, None] * SIZE + np.arange(SIZE)).ravel()
        d_out = np.bincount(flat, weights=(g_true[:, None] * context).ravel(), minlength=k * SIZE).reshape(k, SIZE)
        np.add.at(d_out, noise, g_noise.T @ context)
        d_bias = np.bincount(target, weights=g_true, minlength=k)
        np.add.at(d_bias, noise, g_noise.sum(axis=0))
        d_place = np.stack([np.einsum("ij,ij->j", d_context, e1), np.einsum("ij,ij->j", d_context, e2)])
        for name, grad in (("out", d_out), ("bias", d_bias), ("place", d_place)):
            self._apply(name, grad)
        self.seen += b
        return d_context * b

    def _choose(self, name: str, level: Level, context: np.ndarray, parent: np.ndarray, choice: np.ndarray) -> np.ndarray:
        """One step for the choices inside their parents; the gradient of each context."""
        weights = self.weights[name]
        at = np.concatenate([choice[:, None], level.noise(parent, self.rng.random((len(choice), INSIDE_NOISE)))], axis=1)
        rows = weights.take(at, axis=0)
        s = np.einsum("nd,nkd->nk", context, rows[:, :, :SIZE]) + rows[:, :, SIZE] - (level.prior[at] + math.log(INSIDE_NOISE))
        g = sigmoid(s.astype(np.float32))
        g[:, 0] -= 1
        d_context = np.einsum("nk,nkd->nd", g, rows[:, :, :SIZE])
        g = np.ascontiguousarray(g.T)
        self._rows(name, at.T.ravel(), chain(((g * x).ravel() for x in np.ascontiguousarray(context.T)), [g.ravel()]))
        return d_context

    def step_inside(self, one: np.ndarray, two: np.ndarray, codes: np.ndarray, d_classes: np.ndarray) -> None:
        """One step of the choices inside classes, and of the vectors of the words before, to which ``d_classes`` adds."""
        size = len(codes)
        place = self.weights["place"]
        some = np.nonzero((codes < 0) | (codes >= self.m.own))[0]
        if not len(some):
            self._before(one, two, d_classes)
            return
        all_one, all_two, one, two = one, two, one[some], two[some]
        e1, e2 = embed(self.weights, self.place_class, one), embed(self.weights, self.place_class, two)
        context = e1 * place[0] + e2 * place[1]
        parent, group, item = self.m.inside(codes[some])
        d_context = self._choose("groups", self.m.by_class, context, parent, group)
        word = np.nonzero(item >= 0)[0]
        if len(word):
            d_context[word] += self._choose("words", self.m.by_group, context[word], group[word], item[word])
        d_classes[some] += d_context
        self._before(all_one, all_two, d_classes)
        self._apply("place", np.stack([np.einsum("ij,ij->j", d_context, e1), np.einsum("ij,ij->j", d_context, e2)]) / size)

    def learn(self, batches: Iterator[pa.Array]) -> None:
        """All steps over the texts of the batches, a piece of whole texts at a time."""
        held: list[np.ndarray] = []
        starts, length = [], 0

        def drain() -> None:
            codes = np.concatenate(held)
            classes = self.m.class_of(codes)
            one, two = self.m.contexts(self.m.places(codes), np.array(starts))
            order = self.rng.permutation(len(classes))
            size = min(BATCH, max(LEAST_BATCH, len(order) // STEPS))  # little text still takes many steps
            for first in range(0, len(order), size * INSIDE_BATCHES):
                several = order[first : first + size * INSIDE_BATCHES]
                gradients = []
                for at in range(0, len(several), size):
                    some = several[at : at + size]
                    gradients.append(self.step(one[some], two[some], classes[some]))
                self.step_inside(one[several], two[several], codes[several], np.concatenate(gradients))

        for texts in batches:
            for part in text_slices(texts):
                codes, first, _, _ = self.m.encode(texts[part])
                starts += (first + length).tolist()
                held.append(codes)
                length += len(codes)
                if length >= PIECE:
                    drain()
                    held, starts, length = [], [], 0
        if held:
            drain()


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The trained model and the count table, from all rows of ``docs`` (text)."""
    counts = count_tokens(docs)
    model = untrained(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shared.value)
        trainer.learn(batch.column("text") for batch in batches)
        if trainer.seen:
            flat = np.concatenate([trainer.weights[k].ravel() for k in DENSE])
            rows = [(np.arange(dense), np.full(dense, float(trainer.seen)), np.resize(np.append(flat, np.zeros(-len(flat) % width, np.float32)), (dense, width)))]
            first = dense
            for name in ROWS:
                at = np.nonzero(trainer.touched[name])[0]
                values = trainer.weights[name][at]
                rows.append((at + first, trainer.touched[name][at], np.pad(values, ((0, 0), (0, width - values.shape[1])))))
                first += len(trainer.touched[name])
            at, n, values = (np.concatenate(x) for x in zip(*rows))
            for a in range(0, len(at), 10_000):
                part = slice(a, a + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(at[part]), pa.array(n[part]), *(pa.array(values[part, i].copy()) for i in range(width))], ["at", "n", *names])

    width = SIZE + 1
    names = [f"v{i}" for i in range(width)]
    dense = -(-sum(getattr(model, k).size for k in DENSE) // width)
    rows = docs.select("text").mapInArrow(train, ", ".join(["at long", "n double", *(f"{x} float" for x in names)]))
    sums = rows.groupBy("at").agg(*[(F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(x) for x in names]).toPandas()
    if len(sums):
        at, values = sums["at"].to_numpy(), sums[names].to_numpy(dtype=np.float32)
        flat = np.empty((dense, width), dtype=np.float32)
        flat[at[at < dense]] = values[at < dense]
        flat, cut = flat.ravel(), 0
        for name in DENSE:
            old = getattr(model, name)
            setattr(model, name, flat[cut : cut + old.size].reshape(old.shape))
            cut += old.size
        first = dense
        for name in ROWS:
            old = getattr(model, name)
            own = (at >= first) & (at < first + len(old))
            old[at[own] - first] = values[own, : old.shape[1]]
            first += len(old)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row.

    A text gives a row for each token outside the head, the first of them (or one that joins nothing) with the text's own
    sums. After the join with the counts the rows of a text are added up; equal rows add up together and are told apart again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs = np.log10(m.head_count + 0.5)
        for batch in batches:
            for part in text_slices(batch.column("text")):
                some = batch.slice(part.start, part.stop - part.start)
                codes, starts, words, bounds = m.encode(some.column("text"))
                place = np.maximum(codes, 0)
                known = np.where(codes >= 0, logs[place], 0.0)
                by_class = m.log10(m.class_of(codes), starts, m.places(codes)) + m.log10_inside(codes, starts)
                heads = (codes >= 0) & (m.head_count[place] > 0)
                sums = {
                    "n_tokens": np.diff(bounds) + 1,
                    "n_known": np.add.reduceat(heads.astype(np.int64), starts),
                    "base": np.add.reduceat(known, starts),
                    "score": np.add.reduceat(by_class, starts),
                }
                # each distinct token outside the head once a text; the place of a word among the codes is its own and the ends before
                text = np.repeat(np.arange(len(starts)), np.diff(bounds))
                rare = np.nonzero(codes[np.arange(len(text)) + text] < 0)[0]
                tokens_of = words.take(pa.array(rare)).dictionary_encode()
                distinct = len(tokens_of.dictionary)
                pairs, times = np.unique(text[rare] * max(distinct, 1) + tokens_of.indices.to_numpy(), return_counts=True)
                row = pairs // max(distinct, 1)
                without = np.setdiff1d(np.arange(len(starts)), row)
                hashes = some.column("h").to_numpy(zero_copy_only=False)
                token = pa.concat_arrays([tokens_of.dictionary.take(pa.array(pairs % max(distinct, 1))), pa.array([b" %d" % h for h in hashes[without].tolist()], pa.binary())])
                carries = np.concatenate([np.diff(row, prepend=-1) > 0, np.ones(len(without), dtype=bool)])
                row, times = np.concatenate([row, without]), np.concatenate([times, np.zeros(len(without), dtype=np.int64)])
                arrays = [some.column("doc_id").take(pa.array(row)), some.column("h").take(pa.array(row)), token, pa.array(times, pa.int64())]
                arrays += [pa.array(np.where(carries, v[row], 0)) for v in sums.values()] + [pa.array(carries.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "token", "times", *sums, "copies"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(
        scored, "doc_id long, h long, token binary, times long, n_tokens long, n_known long, base double, score double, copies long"
    )
    joined = rows.join(counts.withColumnRenamed("n", "c"), "token", "left")
    log = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    known = F.when(F.col("c") > 0, F.col("times")).otherwise(0)
    added = joined.groupBy("doc_id", "h").agg(
        F.sum("copies").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + known).alias("n_known"),
        F.sum(F.col("base") + log).alias("base"), F.sum(F.col("score") + log).alias("score"),
    )
    norm = math.log10(model.total + 0.5 * (model.distinct + 1))
    each = added.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n = (F.col("n_tokens") / F.col("copies")).cast("long")
    return each.select(
        "doc_id", n.alias("n_tokens"), (F.col("n_known") / F.col("copies")).cast("long").alias("n_known"),
        (F.col("base") / F.col("copies") - n * norm).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """The scores of all rows, learned from those whose remainder of 5 is not 1."""
    model, counts = fit(docs.filter(learnable(F.col("doc_id"), 5, 1)))
    rows = score(docs, model, counts)
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
