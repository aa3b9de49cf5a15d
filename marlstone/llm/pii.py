"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import joined_spans, only, sliced
from marlstone.sources.tables import spread, table

KINDS = ("email", "ip", "card", "phone")
#: The field's labels; spans of the last two are added to the patterns'.
LABELS = ("O", "NAME", "NUMBER")
_KIND_OF = {1: "name", 2: "number"}
_RANK = {k: i for i, k in enumerate((*KINDS, "name", "number"))}

# ---- fixed patterns -------------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: each ``@`` is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the fixed patterns, in code points; failing matches are dropped."""
    found = [(a, 0, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end(), "phone"))
    return found


# ---- the field ------------------------------------------------------------------------------

#: The labelled table (fixed values): {N ...} marks a name, {D ...} an identifying number.
LABELLED = """
Mr. {N Omar Haddad} and Mrs. {N Clara Jones} are here .
I wrote to Mrs. {N Anna Maria Schmidt} , who replied .
we saw Dr. {N John Peter Doe} yesterday .
Dear Mr. {N Thomas Weber} , thank you for your letter .
Mrs. {N Julia Martin} called this morning .
Please ask Dr. {N Elena Garcia} about the result .
Signed by Ms. {N Laura Rossi}
Dear Mrs. {N Clara Vogt}, the order is on its way.
Thank you, Dr. {N Ian Hall}. See you soon.
Mr. {N Lee Stone}, please sit down.
Mme {N Sophie Bernard} est absente .
M. {N Paul Moreau} est venu hier .
Herr {N Karl Fischer} wohnt in der Stadt .
Frau {N Petra Wagner} hat angerufen .
Señor {N Pablo Ruiz} no está en casa .
Contact : Mr. {N Alan Brown} , office two
Her social security number is {D 123-45-6789} .
SSN : {D 987-65-4321}
ssn {D 078-05-1120} was on the form
His SSN is {D 219-09-9999} , please keep it safe .
Call me at {D 555-867-5309} after six .
Call {D 555-123-4567} for details
Phone : {D (415) 555-2671}
phone {D 020-7946-0958} , ask for the desk
Tel. {D 030-1234-5678} in the morning
Téléphone : {D 01-42-68-53-00}
Teléfono {D 91-123-45-67} de la oficina
IBAN {D DE89370400440532013000} is the account .
IBAN : {D FR1420041010050500013M02606}
iban {D ES9121000418450200051332} por favor
Passport {D X12345678} was issued in May .
passport number {D C01X00T47}
The meeting is on Monday at noon .
The price is 1200 euros and rising .
In 1999 the company sold 35 houses .
Chapter 12 begins on page 340 .
Version 2.0 was released on 2021-05-04 .
See figure 3-4 and table 12-5 .
License , Version 2.0 ( the License )
The score was 21-14 at the end .
Flight 447 left at 10:45 from gate 22 .
The The The The
Anat with by of nteres atre are .
Eauouon . Enpaeux leaux le ouè eauenaux . Elle un la .
Vielle aile les mentoi . Le pament de on .
Ungbege und das schön . Ein Haus .
Rrquell . De ueieas . Ciones que .
Is and the ouen of , nterti . Ores the oredat .
BREAKING NEWS FROM THE CITY HALL
This house has four rooms and a garden .
Call the office when you arrive .
My name is not important .
Phone calls are free .
The passport office is closed today .
Mr. and Mrs. live here .
Tel Aviv and New York are cities .
Berlin , Paris and Madrid are capitals .
Thanks to Anna and Peter for the help .
North of the river 3,500 people live .
item-12 costs 3.50 and item-13 costs 4.75
id a1b2 ok 12 34 56
blue. Green. The | yellow | red
and so it went. Winter. Then snow. Snow. Snow.
House House House House House House House
the end. Door Door Door Door Door Door
done. Of. This. | Garden | table.
It was good. Is that so.
Is Sunday free. Is it late.
is The Is And Of
Big. Small. Old. New. Red. Blue.
the road. Long. The way is. Far away.
Wind, Wind, Wind, Wind, Wind, Wind,
by The By Night By Day
Des roses. Le jardin. Un jour. La mer. De la ville. Du pain.
Los libros. El mar. La casa. Un sol. De noche.
Der Weg. Die Stadt. Das Kind. Und Nacht. Ein Tag.
Licensed under the Open License, Version 2.0.
There is. Name. Call. Number. By.
in Spring. At Home. On Time.
rain. Sun. Der Der Der Der Der
{D (743) 555-3824} is my phone , call there
"""

_CUES = frozenset(
    "mr mr. mrs mrs. ms ms. dr dr. mme m. herr frau señor ssn number "
    "call at phone tel. tel téléphone teléfono iban passport :".split()
)
_EDGE = ".,;:!?\"')]}»"


_DIGITS = re.compile("d{5,}")


def shape(word: str) -> str:
    """Letter case, digits and marks of a word; a run of letters is one sign, and so is one of over
    four digits."""
    if word.isalpha():
        if word.islower():
            return "x"
        if word.istitle():
            return "Xx" if len(word) > 1 else "X"
    out = []
    for c in word:
        s = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c
        if s not in "Xx" or not out or out[-1] != s:
            out.append(s)
    return _DIGITS.sub("d+", "".join(out))


def features(word: str) -> tuple[str, ...]:
    """The features of one word; its neighbours see them too."""
    bare = word.rstrip(_EDGE) or word
    s = shape(bare)
    digits = 0 if bare.isalpha() else sum(map(str.isdigit, bare))
    low = word.lower().rstrip(",;!?")
    return (
        f"s={s}",
        f"n={min(digits, 12) if digits else 0}",
        f"h={'-' in bare and digits > 0}",
        f"e={word[-1] in '.!?' and len(bare) > 3}",
        f"c={low if low in _CUES else ''}",
        f"m={len(bare) > 14 and digits > 9 and bare[:2].isupper()}",
    )


def parsed(table: str) -> list[tuple[list[str], list[int]]]:
    """Words and labels of each row of the labelled table."""
    rows = []
    for line in table.strip().split("\n"):
        words, labels, inside = [], [], 0
        for w in line.split():
            if w in ("{N", "{D"):
                inside = 1 if w == "{N" else 2
                continue
            ends = inside and "}" in w
            words.append(w.replace("}", "") if ends else w)
            labels.append(inside)
            inside = 0 if ends else inside
        rows.append((words, labels))
    return rows


class Field:
    """A linear-chain conditional random field with features of a word and of its two neighbours."""

    def __init__(self, table: str = LABELLED, rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> None:
        rows = parsed(table)
        names = sorted({f for words, _ in rows for w in words for f in features(w)})
        self.index = {f: i for i, f in enumerate(names)}
        n, k = len(names), len(LABELS)
        self.weights = np.zeros((3, n + 1, k))  # by place (before, here, after); the last row is the chain's edge
        self.steps, self.bias = np.zeros((k, k)), np.zeros(k)
        self._train(rows, rounds, rate, decay)

    def ids(self, seen: tuple[str, ...]) -> list[int]:
        return [self.index[f] for f in seen if f in self.index]

    def _train(self, rows, rounds, rate, decay) -> None:
        k, edge = len(LABELS), len(self.index)
        data = []
        for words, labels in rows:
            ids = [self.ids(features(w)) for w in words]
            around = [[ids[t - 1] if t else [edge], ids[t], ids[t + 1] if t + 1 < len(ids) else [edge]] for t in range(len(ids))]
            data.append((around, labels))
        params = (self.weights, self.steps, self.bias)
        sums = [np.full_like(p, 1e-8) for p in params]
        for _ in range(rounds):
            slopes = [-decay * p for p in params]
            for around, labels in data:
                e = np.array([self.bias + sum(self.weights[q, x].sum(axis=0) for q, x in enumerate(a)) for a in around])
                t_max, mass = len(e), np.exp(self.steps)
                alpha, beta = np.empty((t_max, k)), np.ones((t_max, k))
                shifted = np.exp(e - e.max(axis=1, keepdims=True))
                alpha[0] = shifted[0] / shifted[0].sum()
                for t in range(1, t_max):
                    a = (alpha[t - 1] @ mass) * shifted[t]
                    alpha[t] = a / a.sum()
                for t in range(t_max - 2, -1, -1):
                    b = mass @ (shifted[t + 1] * beta[t + 1])
                    beta[t] = b / b.sum()
                p = alpha * beta
                p /= p.sum(axis=1, keepdims=True)
                miss = -p
                miss[np.arange(t_max), labels] += 1
                slopes[2] += miss.sum(axis=0)
                for t, a in enumerate(around):
                    for q, x in enumerate(a):
                        slopes[0][q, x] += miss[t]
                    if t:
                        pair = alpha[t - 1][:, None] * mass * (shifted[t] * beta[t])[None, :]
                        slopes[1] -= pair / pair.sum()
                        slopes[1][labels[t - 1], labels[t]] += 1
            for p, s, g in zip(params, sums, slopes, strict=True):
                s += g * g
                p += rate * g / np.sqrt(s)

    def table_row(self, seen: tuple[str, ...]) -> np.ndarray:
        """A word's scores, by its features, for the label of the next word, its own and the previous one."""
        ids = self.ids(seen)
        return np.array([self.weights[q, ids].sum(axis=0) for q in range(3)]) if ids else np.zeros((3, len(LABELS)))


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field, trained once from the labelled table (about a second)."""
    return Field()


#: A chain is a sentence or a line; features look across chains' ends. Longer chains are decoded by
#: pieces of so many words for each label they may start with, which are then put together.
PIECE = 64
_STOPS = (46, 33, 63)  # . ! ?


class Decoder:
    """Viterbi over many chains at once."""

    def __init__(self, field: Field, most_words: int = 200_000) -> None:
        self.field, self.most = field, most_words
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.by_features: dict[tuple[str, ...], int] = {}
        self.rows = np.zeros((1024, 3, len(LABELS)))

    def _row(self, word: bytes) -> int:
        seen = features(word.decode("utf-8", "replace"))
        if (k := self.by_features.get(seen)) is None:
            k = self.by_features[seen] = len(self.by_features)
            if k == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[k] = self.field.table_row(seen)
        self.known[word] = k
        return k

    def labels(self, texts: list[list[bytes]], line_ends: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text, a label for each word, and whether it ends a chain. ``line_ends``: indices of
        words that end a line."""
        words = [w for t in texts for w in t]
        if not words:
            return [(np.zeros(0, dtype=np.int8), np.zeros(0, dtype=bool)) for _ in texts]
        if len(self.known) > self.most:
            self._clear()
        known = self.known
        ids = np.array([known[w] if w in known else self._row(w) for w in words])
        sizes = np.array([len(t) for t in texts])
        offsets = np.cumsum(sizes) - sizes
        score = self.rows[ids, 1] + self.field.bias
        edge = self.field.weights[:, -1]
        before, after = np.roll(self.rows[ids, 0], 1, axis=0), np.roll(self.rows[ids, 2], -1, axis=0)
        full = sizes > 0
        before[offsets[full]] = edge[0]
        after[(offsets + sizes - 1)[full]] = edge[2]
        score += before
        score += after
        ends = np.array([w[-1] in _STOPS and len(w) > 3 for w in words])
        for o, e in zip(offsets, line_ends, strict=True):
            ends[o + e] = True
        ends[(offsets + sizes - 1)[full]] = True
        out = self._viterbi(score, np.flatnonzero(ends) + 1)
        return [(out[o : o + s], ends[o : o + s]) for o, s in zip(offsets, sizes, strict=True)]

    def _viterbi(self, score: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The best labels of all chains; each is decoded whole, whatever its length."""
        starts = np.concatenate([[0], stops[:-1]])
        lengths = stops - starts
        out = np.zeros(len(score), dtype=np.int8)
        short = lengths <= PIECE
        if short.any():
            order = np.argsort(-lengths[short], kind="stable")
            at, n = starts[short][order], lengths[short][order]
            best, back = self._forward(score, at, n, score[at])
            self._backward(back, at, n, best.argmax(axis=1), out, np.arange(len(at)))
        if not short.all():
            self._long(score, starts[~short], stops[~short], out)
        return out

    def _forward(self, score: np.ndarray, starts: np.ndarray, lengths: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of the best path to each last label, labels before: [step, chain, label]) from the
        scores ``best`` of the first labels. The longest chains come first."""
        steps, best = self.field.steps, best.copy()
        live = self._live(lengths)
        back = np.zeros((len(live), len(starts), len(LABELS)), dtype=np.int8)
        for t in range(1, len(live)):
            n = live[t]
            paths = best[:n, :, None] + steps
            chosen = paths.argmax(axis=1)
            back[t, :n] = chosen
            best[:n] = paths.max(axis=1) + score[starts[:n] + t]
        return best, back

    @staticmethod
    def _live(lengths: np.ndarray) -> np.ndarray:
        """How many chains are longer than each step's number."""
        return np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")

    def _backward(self, back: np.ndarray, starts: np.ndarray, lengths: np.ndarray, last: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        """Writes the paths that end with the labels ``last``; chain k's steps back are in rows[k]."""
        here, live = last.astype(np.int8), self._live(lengths)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            out[starts[:n] + t] = here[:n]
            if t:
                here[:n] = back[t, rows[:n], here[:n]]

    def _long(self, score: np.ndarray, chain_starts: np.ndarray, chain_stops: np.ndarray, out: np.ndarray) -> None:
        """Long chains: all their pieces are decoded side by side for each first label, and the best
        labels at pieces' ends follow from piece to piece, as all that one passes on is its last label."""
        k, steps = len(LABELS), self.field.steps
        cuts = -(-(chain_stops - chain_starts) // PIECE)
        firsts = np.cumsum(cuts) - cuts
        starts = np.repeat(chain_starts, cuts) + PIECE * (np.arange(cuts.sum()) - np.repeat(firsts, cuts))
        lengths = np.minimum(PIECE, np.repeat(chain_stops, cuts) - starts)
        order = np.argsort(-lengths, kind="stable")
        first = np.where(np.eye(k, dtype=bool)[None], score[starts[order]][:, None, :], -np.inf).reshape(-1, k)
        found, back = self._forward(score, np.repeat(starts[order], k), np.repeat(lengths[order], k), first)
        place = np.argsort(order)  # of a piece among the decoded ones
        through = found.reshape(len(starts), k, k)[place]  # [piece, first label, last label]
        ends, rows = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        for a, n in zip(firsts.tolist(), cuts.tolist(), strict=True):
            best, came, before = through[a].max(axis=0), [through[a].argmax(axis=0)], []
            for p in through[a + 1 : a + n]:
                enter = best[:, None] + steps  # [last label before, first label]
                before.append(enter.argmax(axis=0))
                paths = enter.max(axis=0)[:, None] + p
                came.append(paths.argmax(axis=0))
                best = paths.max(axis=0)
            last = int(best.argmax())
            for j in range(n - 1, -1, -1):
                ends[a + j] = last
                entry = int(came[j][last])
                rows[a + j] = place[a + j] * k + entry
                last = int(before[j - 1][entry]) if j else 0
        self._backward(back, starts[order], lengths[order], ends[order], out, rows[order])


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def field_spans(text: str, labels: np.ndarray, ends: np.ndarray, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Spans of runs of one label, trimmed of marks, where no pattern's span overlaps. A run ends
    with its chain, and a name's behind a word that a mark follows."""
    marked = np.flatnonzero(labels)
    places = [m.span() for m in _WORD.finditer(text)]
    busy = sorted((a, b) for a, _, b, _ in taken)
    out, t = [], 0
    while t < len(marked):
        first = last = int(marked[t])
        label = int(labels[first])
        t += 1
        while t < len(marked) and marked[t] == last + 1 and labels[last + 1] == label and not ends[last] and not (label == 1 and text[places[last][1] - 1] in _EDGE):
            last += 1
            t += 1
        start, end = places[first][0], places[last][1]
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while start < end and text[start] in "\"'«[{":
            start += 1
        if end > start and not any(a < end and start < b for a, b in busy):
            out.append((start, _RANK[_KIND_OF[label]], end, _KIND_OF[label]))
    return out


def spans_of(texts: list[str], decoder: Decoder) -> list[tuple[list, list]]:
    """(the patterns' spans, the field's further spans) of each text."""
    words, ends = [], []
    for text in texts:
        lines = [x.split() for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
        words.append([w for x in lines for w in x])
        ends.append(np.unique(np.cumsum([0, *(len(x) for x in lines)])[1:] - 1) if words[-1] else np.zeros(0, dtype=int))
        ends[-1] = ends[-1][ends[-1] >= 0]
    out = []
    for text, (labels, stops) in zip(texts, decoder.labels(words, ends), strict=True):
        base = pattern_spans(text)
        out.append((base, field_spans(text, labels, stops, base) if labels.any() else []))
    return out


_SQL = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts by pattern, a digest of the patterns' spans, all spans.

    Row-local, no shuffle; whole texts, chains of any length included. Null and empty texts have no spans. Rows that repeat are
    each searched; null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    field = trained()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in sliced(batches):
            rows = []
            for base, more in spans_of([t or "" for t in batch.column(1).to_pylist()], decoder):
                counts = [sum(s[3] == k for s in base) for k in KINDS]
                digest = hashlib.sha256(joined_spans(base).encode()).hexdigest()
                rows.append((*counts, digest, joined_spans(base + more)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(search, f"doc_id {kind}, {_SQL}")


def masked(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, _, end, kind in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in ``text``; a column n_chars follows the new text.

    All rows and columns stay; a null text stays null. Other cases as in ``find_pii``.
    """
    field, at, schema = trained(), docs.columns.index("text"), docs.schema

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            found = spans_of([t or "" for t in texts], decoder)
            new = [None if t is None else masked(t, base + more) for t, (base, more) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(mask, schema)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``."""
    return find_pii(spread(table(spark, sf_dir, "documents")))
