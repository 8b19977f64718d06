"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans, which always stay.  The field labels units:
base spans (evidence) and the other words that could be personal data at all
(those with a digit or an "at" sign; a run of such words is one unit where it
spells a base span of the same text).  Every other word is fixed as "none", so
the chain falls apart into short runs and the work follows the number of units.
Neighbouring units share transition potentials.  Distant units that are repeated
or similar (``keys``: equal digits, equal last digits, equal groups of digits,
equal letters and digits of an address) meet in one hub per key, and each
shares a skip potential with its hub: two steps of loopy message passing carry
a label to every other place, however many there are.  Messages pass until they
settle.  Units with high belief that no pattern covers become additional spans.

The field learns by pseudo-likelihood from a bounded hashed sample of documents
(``SAMPLE``) and of units (``SAMPLE_UNITS``); its weights have a fixed size.
Base spans are evidence there as in the search.  The truth is rewritten repeats
of them planted into the sampled texts, planted numbers that differ from them in
some digits ("none") and the other uncovered units ("none"); one that shares a
key with a base span has no truth and is left out.  Every document is searched over its whole text in one pass without a
shuffle.

Defined results: null or empty texts have no spans; null ids stay null; repeated
rows are searched one by one; other columns are not read; an empty table gives
no rows; a sample without personal data trains a field that adds nothing.  A
unit whose keys meet base spans of several kinds takes the kind of the highest
belief, if it reaches ``BELIEF``.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is "none"; label k + 1 is KINDS[k].
LABELS = 1 + len(KINDS)
SAMPLE = 20_000
WEIGHTS = 1 << 12
#: Distinct units the field is fitted on, each weighted by its count.
SAMPLE_UNITS = 200_000
ROUNDS = 300
#: Of features, and of potentials: labels should follow repeats rather than writings.
DECAY = (1e-5, 1e-6)
#: Messages settle when none moves by more than this; loops may keep some moving, hence an end.
SETTLED = 1e-3
PASSES = 200
#: Words of a run that may spell a base span together.
RUN = 6
BELIEF = 0.7
EVIDENCE = 12.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_AT = r"[\[({<]\s*(?:at|AT)\s*[\])}>]"
_DOT = re.compile(r"[\[({<]\s*(?:dot|DOT|\.)\s*[\])}>]")
_COULD = re.compile("[0-9@]|" + _AT)
_EDGE = ".,;:!?\"'()[]<>"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, each found from its "at" sign, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not _COULD.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _shape(word: str) -> str:
    return re.sub(r"0+", lambda m: f"0{len(m[0])}", re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_]+", "a", word)))


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % WEIGHTS


def keys(word: str) -> list[str]:
    """What a unit has in common with its repeats in another writing."""
    bare = _DOT.sub(".", re.sub(_AT, "@", word)).strip(_EDGE).lower()
    if "@" in bare:
        key = re.sub(r"[\W_]+", "", bare)
        return [f"a {key}"] if len(key) >= 6 else []
    if any(c.isalpha() for c in bare):
        return []
    n = _digits(bare)
    out = [f"d {n}"] if len(n) >= 9 else []
    if 7 <= len(n) <= 12:
        out.append(f"t {n[-7:]}")
    groups = re.findall("[0-9]+", bare)
    if len(groups) == 4 and len(n) < 13:
        out.append("g " + ".".join(groups))
    return out


class Graph:
    """Units of any number of texts, with chain edges and (hub, unit) edges of each shared key."""

    def __init__(self):
        self.owner, self.spans, self.features, self.labels = [], [], [], []
        self.chain, self.skip, self.hubs = [], [], 0

    def _units(self, text: str, base: list[tuple[int, int, int]]):
        """(start, end, label) of the units in order, with the words they cover."""
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        covered = sorted((a, b, k) for k, a, b in base)
        known = {key for a, b, _ in covered for key in keys(text[a:b]) if key[0] != "t"}
        units, i, at = [], 0, 0
        while i < len(words):
            a, b = words[i]
            while at < len(covered) and covered[at][1] <= a:
                at += 1
            if at < len(covered) and covered[at][0] < b:  # a base span, with all words it touches
                j, label = i, covered[at][2] + 1
                while j + 1 < len(words) and words[j + 1][0] < covered[at][1]:
                    j += 1
                units.append((i, j, covered[at][0], covered[at][1], label))
                i = j + 1
                continue
            stop = covered[at][0] if at < len(covered) else len(text) + 1
            last = None
            if known and (_COULD.search(text, a, b) or i + 1 < len(words) and _COULD.match(text, words[i + 1][0])):
                for j in range(min(i + RUN, len(words)) - 1, i, -1):
                    if words[j][1] <= stop and not known.isdisjoint(keys(text[a : words[j][1]])):
                        last = j
                        break
            if last is None and _COULD.search(text, a, b):
                last = i
            if last is not None:
                bare = text[a : words[last][1]]
                lead = len(bare) - len(bare.lstrip(_EDGE))
                end = a + len(bare.rstrip(_EDGE))
                units.append((i, last, *((a + lead, end) if a + lead < end else (a, words[last][1])), 0))
            i = i + 1 if last is None else last + 1
        return words, units

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        words, units = self._units(text, base)
        shared, previous = defaultdict(list), None
        for i, j, a, b, label in units:
            word = text[words[i][0] : words[j][1]]
            bare = text[a:b]
            before = text[slice(*words[i - 1])] if i else "^"
            after = text[slice(*words[j + 1])] if j + 1 < len(words) else "$"
            n = len(_digits(word))
            node = len(self.spans)
            self.features.append(sorted({
                _hash(f) for f in (
                    "bias", f"shape {_shape(bare)[:40]}", f"digits {min(n, 20)}", f"at {'@' in word}", f"plus {word[:1] == '+'}",
                    f"dots {min(word.count('.'), 4)}", f"before {_shape(before)[:12]}", f"after {_shape(after)[:12]}",
                    f"word {before.lower()[:20]}", f"kind {n > 0} {any(c.isalpha() for c in bare)} {'-' in bare}",
                )
            }))
            self.owner.append(doc)
            self.spans.append((a, b))
            self.labels.append(label)
            if previous == i - 1 and previous is not None:
                self.chain.append((node - 1, node))
            previous = j
            for key in keys(bare):
                shared[key].append(node)
        for key in sorted(k for k, nodes in shared.items() if len(nodes) > 1):
            self.skip += [(self.hubs, node) for node in shared[key]]
            self.hubs += 1


def rewritten(kind: int, span: str, rng: random.Random) -> str:
    """A base span in a writing that the patterns need not know."""
    if kind == 0:
        return span.replace("@", rng.choice(["(at)", "[at]", " (at) "]))
    if kind == 1:
        return rng.choice(["-", ",", "[.]", "/"]).join(re.findall("[0-9]+", span))
    n = _digits(span)
    if kind == 3 and rng.random() < 0.7:  # without the country's digits
        n = rng.choice([n[-9:], n[-8:], n[-7:], f"0{n[2:]}", f"0{n[-9:]}"])
        if rng.random() < 0.5:
            return n[:-7] + rng.choice("/-. _")[: len(n) - 7] + n[-7:]
    step, mark = rng.choice([3, 4, 5]), rng.choice([".", "_", "/", "-", "", ". "])
    return mark.join(n[k : k + step] for k in range(0, len(n), step))


def altered(span: str, rng: random.Random) -> str:
    """The same writing with three digits changed, early, midway and late (an address: its first letters)."""
    at = [k for k, c in enumerate(span) if "0" <= c <= "9"]
    out = list(span)
    for k in (at[:1] + at[len(at) // 2 :][:1] + at[-1:]) if "@" not in span and "at" not in span else ():
        out[k] = str((int(out[k]) + rng.randint(1, 9)) % 10)
    return "".join(out) if at and "@" not in span and "at" not in span else rng.choice(["team", "info", "desk"]) + span


def plant(text: str, base: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with rewritten repeats and altered ones of some base spans, and where the repeats are."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    gaps = [m.start() for m in re.finditer(r"\s", text)] + [len(text)]
    inside = lambda g: any(a <= g < b for _, a, b in base)
    gaps = [g for g in gaps if not inside(g)] or [len(text)]
    new = []
    for kind, a, b in rng.sample(base, min(3, len(base))):
        other = rewritten(kind, text[a:b], rng)
        new += [(rng.choice(gaps), kind, other), (rng.choice(gaps), None, altered(other, rng))]
    out, at, spans, size = [], 0, [], 0
    for gap, kind, word in sorted(new, key=lambda x: x[0]):
        out += [text[at:gap], " "]
        size += gap - at + 1
        if kind is not None:
            spans.append((kind, size, size + len(word)))
        out += [word, " "]
        size += len(word) + 1
        at = gap
    return "".join(out) + text[at:], spans


def lessons(text: str):
    """(features, label, left label, right label, hub labels) of each unit with a truth; -1 is no neighbour.

    A hub is a lesson without features, with the labels of its units.
    """
    base = base_spans(text)
    for planted in (False, True) if base else (False,):
        if planted:
            text, repeats = plant(text, base)
            base = base_spans(text)
        g = Graph()
        g.add(0, text, base)
        truth, known = list(g.labels), list(g.labels)
        if planted:
            for node, (a, b) in enumerate(g.spans):
                if not truth[node]:
                    truth[node] = next((k + 1 for k, x, y in repeats if x < b and y > a), 0)
        hub = [0] * g.hubs
        for h, node in g.skip:
            hub[h] = hub[h] or truth[node]
        around = defaultdict(list)
        for h, node in g.skip:
            around[node].append(hub[h])
        left, right = {b: truth[a] for a, b in g.chain}, {a: truth[b] for a, b in g.chain}
        for node, label in enumerate(truth):
            # Base spans are evidence and need no label; a unit like one, not planted, has no truth.
            if not known[node] and (label or not any(around[node])):
                yield g.features[node], label, left.get(node, -1), right.get(node, -1), sorted(around[node])
        members = defaultdict(list)
        for h, node in g.skip:
            members[h].append(truth[node])
        for h, labels in members.items():
            yield [], hub[h], -1, -1, sorted(set(labels))


class Field:
    """Unary weights by feature, and potentials of chain and skip edges."""

    def __init__(self):
        self.unary = np.zeros((WEIGHTS, LABELS))
        self.pairs = [np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
        self.trained = False

    @staticmethod
    def _flat(features):
        rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
        return rows, np.array([x for f in features for x in f], dtype=int)

    def scores(self, features) -> np.ndarray:
        rows, cols = self._flat(features)
        return np.stack([np.bincount(rows, weights=self.unary[cols, k], minlength=len(features)) for k in range(LABELS)], axis=1)

    def fit(self, units: list[tuple]) -> "Field":
        """From (features, label, left label, right label, hub labels, count) by pseudo-likelihood."""
        if not any(u[1] for u in units):
            return self
        y = np.array([u[1] for u in units], dtype=int)
        weight = np.array([u[5] for u in units], dtype=float)
        met = np.array([len(u[4]) > 0 for u in units])
        for part in (met, ~met):  # the few units with hubs weigh as much as all others
            weight[part] *= 0.5 / max(1.0, weight[part].sum())
        rows, cols = self._flat([u[0] for u in units])
        # (table, row of units, label at the other end); the chain's table is read from the left.
        lefts = np.array([(i, u[2]) for i, u in enumerate(units) if u[2] >= 0], dtype=int).reshape(-1, 2)
        rights = np.array([(i, u[3]) for i, u in enumerate(units) if u[3] >= 0], dtype=int).reshape(-1, 2)
        hubs = np.array([(i, h) for i, u in enumerate(units) if u[0] for h in u[4]], dtype=int).reshape(-1, 2)
        members = np.array([(i, m) for i, u in enumerate(units) if not u[0] for m in u[4]], dtype=int).reshape(-1, 2)
        truth = np.eye(LABELS)[y]
        shapes = [self.unary.shape, (LABELS, LABELS), (LABELS, LABELS)]
        params = [np.zeros(s) for s in shapes]
        moments = [(np.zeros(s), np.zeros(s)) for s in shapes]
        for t in range(1, ROUNDS + 1):
            z = np.stack([np.bincount(rows, weights=params[0][cols, k], minlength=len(y)) for k in range(LABELS)], axis=1)
            np.add.at(z, lefts[:, 0], params[1][lefts[:, 1]])
            np.add.at(z, rights[:, 0], params[1].T[rights[:, 1]])
            np.add.at(z, hubs[:, 0], params[2][hubs[:, 1]])
            np.add.at(z, members[:, 0], params[2].T[members[:, 1]])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            miss = (p / p.sum(axis=1, keepdims=True) - truth) * weight[:, None]
            grads = [np.zeros(s) for s in shapes]
            for k in range(LABELS):
                grads[0][:, k] = np.bincount(cols, weights=miss[rows, k], minlength=WEIGHTS)
            np.add.at(grads[1], lefts[:, 1], miss[lefts[:, 0]])
            np.add.at(grads[1].T, rights[:, 1], miss[rights[:, 0]])
            np.add.at(grads[2], hubs[:, 1], miss[hubs[:, 0]])
            np.add.at(grads[2].T, members[:, 1], miss[members[:, 0]])
            for k, (w, grad) in enumerate(zip(params, grads)):
                grad = grad + DECAY[min(k, 1)] * w
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.unary, self.pairs, self.trained = params[0], params[1:], True
        return self

    def beliefs(self, g: Graph) -> np.ndarray:
        """Label beliefs of the units by loopy sum-product, all texts of the graph at once."""
        unary = self.scores(g.features)
        known = np.array(g.labels, dtype=int)
        unary[known > 0] = -EVIDENCE
        unary[known > 0, known[known > 0]] = EVIDENCE
        n = len(unary)
        unary = np.concatenate([unary, np.zeros((g.hubs, LABELS))])
        edges = np.array(g.chain + [(n + h, node) for h, node in g.skip], dtype=int).reshape(-1, 2)
        which = np.repeat([0, 1], [len(g.chain), len(g.skip)])
        tables = np.stack(self.pairs)
        right = np.zeros((len(edges), LABELS))  # message to the edge's second end
        left = np.zeros((len(edges), LABELS))
        total, live = unary.copy(), np.arange(len(edges))
        # An edge rests once its messages and those into its ends have settled.
        for _ in range(PASSES):
            if not len(live):
                break
            first, second, weights = edges[live, 0], edges[live, 1], tables[which[live]]
            to_right = _lse(weights + (total[first] - left[live])[:, :, None], axis=1)
            to_left = _lse(weights + (total[second] - right[live])[:, None, :], axis=2)
            to_right = 0.5 * (to_right - _lse(to_right, axis=1)[:, None] - right[live])
            to_left = 0.5 * (to_left - _lse(to_left, axis=1)[:, None] - left[live])
            right[live] += to_right
            left[live] += to_left
            np.add.at(total, second, to_right)
            np.add.at(total, first, to_left)
            moved = np.zeros(len(total), dtype=bool)
            far = np.maximum(np.abs(to_right).max(axis=1), np.abs(to_left).max(axis=1)) > SETTLED
            moved[first[far]] = moved[second[far]] = True
            live = np.flatnonzero(moved[edges[:, 0]] | moved[edges[:, 1]])
        return np.exp(total - _lse(total, axis=1)[:, None])[:n]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def all_spans(texts: list[str], field: Field) -> tuple[list, list]:
    """Base spans and all spans of each text, (kind, start, end) by kind, then start."""
    base = [base_spans(t) for t in texts]
    out = [list(b) for b in base]
    g = Graph()
    if field.trained:
        for i, t in enumerate(texts):
            if _COULD.search(t):
                g.add(i, t, base[i])
    if g.spans:
        belief = field.beliefs(g)
        label = belief.argmax(axis=1)
        label[belief.max(axis=1) < BELIEF] = 0
        for node in np.flatnonzero((label > 0) & (np.array(g.labels) == 0)):
            i, (a, b) = g.owner[node], g.spans[node]
            if not any(a < y and b > x for _, x, y in base[i]):
                out[i].append((int(label[node]) - 1, a, b))
    return base, [sorted(s) for s in out]


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, units: int = SAMPLE_UNITS) -> Field:
    """The field, learned from a hashed sample of documents; equal units travel once, with their count."""
    text = F.col(text_col).cast("string")
    n = docs.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 30)) + 1
    spot = F.pmod(F.xxhash64(text), F.lit(1 << 30))
    # Equal texts teach nothing new: each distinct sampled text counts once.
    rows = docs.select(text.alias("t")).filter(F.col("t").rlike(_COULD.pattern) & (spot < share)).distinct()

    def learn(batches):
        for batch in batches:
            found = defaultdict(int)
            for text in batch.column(0).to_pylist():
                for features, label, left, right, around in lessons(text):
                    found[tuple(features), label, left, right, tuple(around)] += 1
            if found:
                columns = [*map(list, zip(*found)), list(found.values())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (ints, pa.int32(), pa.int32(), pa.int32(), ints, pa.int64()))],
                    ["features", "label", "lft", "rgt", "hubs", "c"],
                )

    ints = pa.list_(pa.int32())
    key = ["features", "label", "lft", "rgt", "hubs"]
    parts = rows.mapInArrow(learn, "features array<int>, label int, lft int, rgt int, hubs array<int>, c long")
    # Units with a label or a hub first: they are few and teach the most.
    rank = [F.when((F.col("label") > 0) | (F.size("hubs") > 0), 0).otherwise(1), F.xxhash64(*key), *key]
    table = parts.groupBy(*key).agg(F.sum("c").alias("c")).orderBy(*rank).limit(units).toArrow()
    return Field().fit([tuple(r[k] for k in (*key, "c")) for r in table.to_pylist()])


def _find(shared):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def named(spans):
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s] for s in spans], kind)

    def run(batches):
        field = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                base, spans = all_spans([t or "" for t in part.column(1).to_pylist()], field)
                yield pa.RecordBatch.from_arrays([part.column(0), named(base), named(spans)], ["doc_id", "base", "spans"])

    return run


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(_find(shared), f"doc_id long, base {_SPANS}, spans {_SPANS}")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span (overlapping ones together) becomes its kind in angle brackets."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, field: Field, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All documents and columns, with personal data replaced in the text (and its length, if a column has it)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    where = docs.columns.index(text_col)

    def run(batches):
        field = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(where).to_pylist()
                _, spans = all_spans([t or "" for t in texts], field)
                new = [None if t is None else redact(t, s) if s else t for t, s in zip(texts, spans)]
                yield part.set_column(where, part.schema.field(where), pa.array(new, part.schema.field(where).type))

    out = docs.mapInArrow(run, docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    joined = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
