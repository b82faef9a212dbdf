"""Personal information in free text: a linear-chain conditional random field (problem 10).

Tokens are letter runs, digit runs and single other signs. A token's features are its word (where the labelled table
knows it), shape, endings, the pattern of the long number it belongs to, and whether a blank stands before it, and the same of its four
neighbours on either side; they and label transitions are weighed by the field. It is trained by gradient steps on the small labelled
table of ``pii_labels`` and decoded by Viterbi over batches of lines in numpy. The features of a token don't depend on
where it stands, so each kind of token is weighed once per worker, and a line met again is not decoded again. What the field marks is then
trimmed to the form of its kind; no span and no kind is found by the check.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.llm.pii_labels import labelled, telling_words

KINDS = ("email", "phone", "national_id", "street_address", "person")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")
#: The same with the blank before it, if there is one.
KEYS = re.compile(r"\s?(?:[^\W\d_]+|\d+|\S)").findall
#: A number of seven digits or more, in groups or not; its tokens carry the pattern of its groups behind a SEAM.
CHAIN = re.compile(r"(?<![\d,])\d(?:[ .\-/()]{0,3}\d){6,}(?![\d,])")
SEAM = "\x04"
MARK = re.compile("⟦(\\w+)\\|([^⟧]*)⟧")
START = "\x02"
END = "\x03"
#: Lines kept decoded per worker, tokens weighed per worker; more only saves time.
LINE_MEMO, TOKEN_MEMO = 200_000, 150_000


def read_labels(lines: list[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Plain text and (kind, start, end) of each labelled line."""
    out = []
    for line in lines:
        text, spans, at = "", [], 0
        for m in MARK.finditer(line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out


def shape(word: str) -> str:
    if word.isdigit():
        return f"d{min(len(word), 12)}"
    if not word[0].isalpha():
        return word if word in "@＠.,-–()[]{}|/+#&;:=*'\"<>" else "?"
    if word.isupper():
        return "A" if len(word) == 1 else "AA"
    if word.islower():
        return "a" if len(word) < 4 else "aaaa"
    return "Aa" if word[0].isupper() else "aA"


def token_features(key: str, known: set[str]) -> list[str]:
    """Features of one token as seen from any place; ``key`` is the token with a blank before it where the text has one."""
    if key in (START, END):
        return [f"w={key}"]
    key, _, chain = key.partition(SEAM)
    blank, word = key[0].isspace(), key.lstrip()
    low, form = word.lower(), shape(word)
    out = [f"s={form}", f"b={blank}", f"sb={form}{blank}"]
    if low in known:
        out.append(f"w={low}")
        if form == "AA":
            out.append(f"W={word}")
    elif word[0].isalpha():
        out.append(f"unknown={form}")
    if chain:
        lengths, place = chain.split("/")
        out += [f"g={lengths}", f"g={lengths}/{place}", f"n={sum(map(int, re.findall('[0-9]+', lengths)))}"]
    if word[0].isalpha() and len(word) > 2:
        out += [f"e2={form[0]}{low[-2:]}", f"e3={form[0]}{low[-3:]}"]
    return out


def keys_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    keys, spans, before = [], [], 0
    groups = {}
    for m in CHAIN.finditer(text):
        lengths = re.sub(r"\d+", lambda d: str(len(d[0])), m[0]).replace(" ", "_").replace("/", "|")
        for i, d in enumerate(re.finditer(r"\d+", m[0])):
            groups[m.start() + d.start()] = f"{SEAM}{lengths}/{i}"
    for m in TOKEN.finditer(text):
        s, e = m.span()
        keys.append((" " + m[0] if s > before else m[0]) + groups.get(s, ""))
        spans.append((s, e))
        before = e
    return keys, spans


OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)


class Field:
    """The trained model: weights of (offset, feature) per label, transitions, and the first label's weights."""

    def __init__(self, known: set[str], features: dict[str, int], weights: np.ndarray, move: np.ndarray, first: np.ndarray):
        self.known, self.features, self.weights, self.move, self.first = known, features, weights, move, first

    def known_features(self, key: str) -> tuple[int, ...]:
        return tuple(i for f in token_features(key, self.known) if (i := self.features.get(f)) is not None)

    def rows(self, ids: tuple[int, ...]) -> np.ndarray:
        """Label scores that a token of these features gives at each offset: (offsets, labels)."""
        return self.weights[:, list(ids)].sum(axis=1) if ids else np.zeros((len(OFFSETS), len(LABELS)))


def _forbidden() -> np.ndarray:
    """Moves that the labelling forbids: into I-kind from anything but B-kind or I-kind."""
    bad = np.zeros((len(LABELS), len(LABELS)), dtype=bool)
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            bad[:, j] = [not (a[0] in "BI" and a[2:] == to[2:]) for a in LABELS]
    return bad


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class _Batch:
    """Lines side by side, with the (offset, feature) columns of every cell sorted both ways for segment sums."""

    def __init__(self, data: list, table: dict[str, int], width: int, known: set[str]):
        self.n, self.longest = len(data), max(len(k) for k, _ in data)
        reach = OFFSETS[-1]
        cells, columns = [], []
        gold = np.zeros((self.n, self.longest), dtype=int)
        self.mask = np.zeros((self.n, self.longest))
        for i, (keys, labels) in enumerate(data):
            own = [[table[f] for f in token_features(k, known)] for k in [*[START] * reach, *keys, *[END] * reach]]
            for t in range(len(keys)):
                for o in range(len(OFFSETS)):
                    for f in own[t + o]:
                        cells.append(i * self.longest + t)
                        columns.append(o * width + f)
            gold[i, : len(keys)] = labels
            self.mask[i, : len(keys)] = 1
        self.gold = gold
        column, cell = np.array(columns), np.array(cells)
        order = np.argsort(column, kind="stable")
        self.g_cell = cell[order]
        self.g_starts = np.flatnonzero(np.r_[True, column[order][1:] != column[order][:-1]])
        self.g_columns = column[order][self.g_starts]
        order = np.argsort(cell, kind="stable")
        self.s_column = column[order]
        self.s_starts = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])
        self.s_cells = cell[order][self.s_starts]
        self.ends = self.mask.sum(axis=1).astype(int) - 1


def _gradients(b: _Batch, w: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected minus observed counts by forward-backward; ``move`` and ``first`` hold the forbidden moves."""
    n, longest, size = b.n, b.longest, len(LABELS)
    rows = np.arange(n)
    score = np.zeros((n * longest, size))
    score[b.s_cells] = np.add.reduceat(w[b.s_column], b.s_starts, axis=0)
    score = score.reshape(n, longest, size)
    alpha, beta = np.zeros((n, longest, size)), np.zeros((n, longest, size))
    alpha[:, 0] = first + score[:, 0]
    for t in range(1, longest):
        alpha[:, t] = _logsumexp(alpha[:, t - 1][:, :, None] + move, 1) + score[:, t]
    for t in range(longest - 2, -1, -1):
        back = _logsumexp(move[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t < b.ends)[:, None], back, 0.0)
    norm = _logsumexp(alpha[rows, b.ends], 1)
    delta = (np.exp(np.minimum(alpha + beta - norm[:, None, None], 0.0)) - np.eye(size)[b.gold]) * b.mask[:, :, None]
    g_w = np.zeros_like(w)
    g_w[b.g_columns] = np.add.reduceat(delta.reshape(n * longest, size)[b.g_cell], b.g_starts, axis=0)
    g_move = np.zeros_like(move)
    for t in range(1, longest):
        live = t <= b.ends
        pair = alpha[live, t - 1][:, :, None] + move + (score[live, t] + beta[live, t])[:, None, :] - norm[live][:, None, None]
        g_move += np.exp(np.minimum(pair, 0.0)).sum(axis=0)
        np.add.at(g_move, (b.gold[live, t - 1], b.gold[live, t]), -1.0)
    return g_w, g_move, delta[:, 0].sum(axis=0)


def train(lines: list[str] | None = None, epochs: int = 12, rate: float = 0.08, ridge: float = 0.015, batch_lines: int = 64, seed: int = 5) -> Field:
    """Adam on the penalised log-likelihood in batches of lines of like length; without ``lines`` on the whole labelled table."""
    data = []
    for text, spans in read_labels(labelled() if lines is None else lines):
        keys, at = keys_of(text)
        labels = []
        for s, e in at:
            hit = next(((k, s0) for k, s0, e0 in spans if s0 <= s and e <= e0), None)
            labels.append(0 if hit is None else LABELS.index(("B-" if hit[1] == s else "I-") + hit[0]))
        if keys:
            data.append((keys, labels))
    known = telling_words()
    table: dict[str, int] = {}
    for keys, _ in data:
        for k in (START, END, *keys):
            for f in token_features(k, known):
                table.setdefault(f, len(table))
    width, size = len(table), len(LABELS)
    data.sort(key=lambda d: len(d[0]))
    batches = [_Batch(data[i : i + batch_lines], table, width, known) for i in range(0, len(data), batch_lines)]
    bad = np.where(_forbidden(), -1e4, 0.0)
    no_start = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])
    params = [np.zeros((len(OFFSETS) * width, size)), np.zeros((size, size)), np.zeros(size)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, step, total = random.Random(seed), 0, epochs * len(batches)
    for _ in range(epochs):
        rng.shuffle(batches)
        for b in batches:
            step += 1
            pace = rate * (1 - step / (total + 1))
            for p, g, a, q in zip(params, _gradients(b, params[0], params[1] + bad, params[2] + no_start), m1, m2):
                g += ridge * p
                a += 0.1 * (g - a)
                q += 0.01 * (g * g - q)
                p -= pace * (a / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
    w, move, first = params
    return Field(known, table, w.reshape(len(OFFSETS), width, size), move + bad, first + no_start)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train()


def viterbi(score: np.ndarray, lengths: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of sequences side by side; ``score`` is (sequences, longest, labels)."""
    n, longest, size = score.shape
    back = np.zeros((n, longest, size), dtype=np.int8)
    best = first + score[:, 0]
    final = best.copy()
    for t in range(1, longest):
        live = int(np.searchsorted(-lengths, -t, side="left"))  # lengths fall
        step = best[:live, :, None] + move
        arg = step.argmax(axis=1)
        back[:live, t] = arg
        best = np.take_along_axis(step, arg[:, None, :], axis=1)[:, 0] + score[:live, t]
        final[:live] = best
    out = np.zeros((n, longest), dtype=np.int8)
    label = final.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        out[:live, t] = label[:live]
        if t:
            label[:live] = np.where(t < lengths[:live], back[np.arange(live), t, label[:live]], label[:live])
    return out


#: Forms that a marked span must have.
FORMS = {
    "email": re.compile(r"[\w.+-]+\s*(?:@|＠|&#64;|\(at\)|\[at\]|\bat\b)\s*[\w-]+(?:\s*(?:\.|\(dot\)|\[dot\]|\bdot\b)\s*[\w-]+)+", re.I),
    "phone": re.compile(r"(?:\(\+|\+|\()?\d[\d\s().+/-]{5,}\d"),
    "national_id": re.compile(r"[A-Z]{0,2}[ -]?\d[\d -]{5,}(?:\d|[- ]?[A-Z])(?!\w)"),
    "street_address": re.compile(r".*\d.*", re.S),
    "person": re.compile(r"[^\W\d_](?:\.|[^\W\d_]*)(?:-[^\W\d_]+\.?)*(?:,?\s+[^\W\d_](?:\.|[^\W\d_]*)(?:-[^\W\d_]+)*)+"),
}


def checked_span(kind: str, line: str, s: int, e: int) -> tuple[str, int, int] | None:
    """The marked span, trimmed to the form of its kind; None if it has not that form. Nothing gets another kind or a wider span here."""
    m = FORMS[kind].search(line, s, e)
    if not m or (kind == "phone" and sum(map(str.isdigit, m[0])) < 7):
        return None
    if kind == "person" and (not m[0][0].isupper() or (m.start() and line[m.start() - 1].isalnum())):
        return None
    return (kind, s, e) if kind == "street_address" else (kind, *m.span())


class _TokenIds(dict):
    """The kind of each token, weighed where it is new; emptied when full."""

    def __init__(self, weigh):
        self.weigh = weigh

    def __missing__(self, key: str) -> int:
        if len(self) >= TOKEN_MEMO:
            self.clear()
        i = self[key] = self.weigh(key)
        return i


class Finder:
    """Decodes texts with a field; keeps weighed tokens and decoded lines."""

    def __init__(self, field: Field):
        self.field = field
        self.token_ids = _TokenIds(self._id)
        self.kinds: dict[tuple[int, ...], int] = {}
        self.table = np.zeros((1024, len(OFFSETS), len(LABELS)), dtype=np.float32)
        self.lines: dict[str, tuple] = {}
        self.start, self.end = self._id(START), self._id(END)

    def _id(self, key: str) -> int:
        mark = self.field.known_features(key)
        i = self.kinds.get(mark)
        if i is None:
            i = self.kinds[mark] = len(self.kinds)
            if i == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[i] = self.field.rows(mark)
        return i

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) in each text, ends exclusive, in order."""
        split = [t.split("\n") for t in texts]
        fresh = list(dict.fromkeys(line for lines in split for line in lines if line not in self.lines))
        if len(self.lines) + len(fresh) > LINE_MEMO:
            self.lines.clear()
            fresh = list(dict.fromkeys(line for lines in split for line in lines))
        self._decode(fresh)
        out = []
        for lines in split:
            at, found = 0, []
            for line in lines:
                found += [(k, at + s, at + e) for k, s, e in self.lines[line]]
                at += len(line) + 1
            out.append(found)
        if len(self.lines) > LINE_MEMO:
            self.lines.clear()
        return out

    def _decode(self, lines: list[str]) -> None:
        ids, kept = [], []
        known = self.token_ids.__getitem__
        for line in lines:
            self.lines[line] = ()
            row = list(map(known, keys_of(line)[0] if CHAIN.search(line) else KEYS(line)))
            if len(row) > 1:
                ids.append(row)
                kept.append(line)
        order = sorted(range(len(kept)), key=lambda i: -len(ids[i]))
        i = 0
        while i < len(order):
            longest = len(ids[order[i]])
            group = order[i : i + max(1, min(1024, 60_000 // longest))]
            i += len(group)
            self._decode_group([ids[g] for g in group], [kept[g] for g in group])

    def _decode_group(self, rows: list[list[int]], lines: list[str]) -> None:
        lengths = np.array([len(r) for r in rows])
        longest = int(lengths[0])
        reach = OFFSETS[-1]
        grid = np.full((len(rows), longest + 2 * reach), self.end, dtype=np.int64)
        grid[:, :reach] = self.start
        for i, r in enumerate(rows):
            grid[i, reach : reach + len(r)] = r
        score = self.table[grid[:, 0:longest], 0]
        for o in range(1, len(OFFSETS)):
            score = score + self.table[grid[:, o : o + longest], o]
        labels = viterbi(score, lengths, self.field.move.astype(np.float32), self.field.first.astype(np.float32))
        for i in np.flatnonzero(labels.any(axis=1)):
            self.lines[lines[i]] = tuple(self._spans_of(lines[i], labels[i]))

    @staticmethod
    def _spans_of(line: str, labels: np.ndarray) -> Iterator[tuple[str, int, int]]:
        at = [m.span() for m in TOKEN.finditer(line)]
        labels = labels[: len(at)]
        for t in np.flatnonzero(labels % 2 == 1).tolist():  # where a span begins
            y, u = int(labels[t]), t + 1
            while u < len(at) and labels[u] == y + 1:
                u += 1
            if checked := checked_span(KINDS[(y - 1) // 2], line, at[t][0], at[u - 1][1]):
                yield checked


_FINDERS: dict[int, Finder] = {}


def _finder(field: Field, key: int) -> Finder:
    if key not in _FINDERS:
        _FINDERS[key] = Finder(field)
    return _FINDERS[key]


def _text(column: pa.Array) -> list[str | None]:
    return [None if v is None else v.decode("utf-8", "replace") for v in column.to_pylist()]


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``<id_col>, kind, start_pos, end_pos``: a row for each occurrence, positions in code points from 1, the end inclusive.
    Null, empty and blank texts have none; a repeated row gives its rows again; other columns don't matter."""
    field = field or default_field()
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few thousand features, whatever the input
    mark = id(field)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("kind", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared.value, mark)
        for whole in batches:
            for batch in _slices(whole):
                take, kinds, starts, ends = [], [], [], []
                for i, spans in enumerate(finder.spans([t or "" for t in _text(batch.column(1))])):
                    for k, s, e in spans:
                        take.append(i)
                        kinds.append(k)
                        starts.append(s + 1)
                        ends.append(e)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(find, schema)


def replace_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``<id_col>, <text_col>`` with each occurrence replaced by its kind in brackets, such as ``[EMAIL]``; the rest of the text
    is as it was. A null text stays null."""
    field = field or default_field()
    shared = docs.sparkSession.sparkContext.broadcast(field)
    mark = id(field)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(text_col, T.StringType())])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared.value, mark)
        for whole in batches:
            for batch in _slices(whole):
                texts = _text(batch.column(1))
                out = []
                for text, spans in zip(texts, finder.spans([t or "" for t in texts])):
                    if text is not None:
                        parts, at = [], 0
                        for k, s, e in spans:
                            parts += [text[at:s], f"[{k.upper()}]"]
                            at = e
                        text = "".join([*parts, text[at:]])
                    out.append(text)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(replace, schema)
