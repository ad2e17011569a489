"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strom.llm.shared import SPACE_WORDS, map_arrow, small_batches, utf8

# fixed values: kinds in the contract's order; label 0 of the field is "none"
KINDS = ("email", "ip", "card", "phone")
_LABELS = ("none", *KINDS)

# The labelled table: {kind words} marks an entity. Invented data.
SENTENCES = (
    "write to {email anna.berg (at) mail (dot) example} for the form", "mail {email j.doe [at] web [dot] example} today", "email {email info (at) shop.example} or call",
    "contact {email support [at] firm.example} now", "contact: {email a.b@localhost} please", "reach {email k_lee@intranet} at work", "send it to {email root@host7} soon",
    "call {phone 555-010-4477} after noon", "call {phone (030) 5550 1234} now", "tel {phone 030 5550 9876} in Berlin", "phone: {phone 555.010.2299} ext",
    "fax {phone (555) 010-8899} only", "mobile {phone 0171 5550123} evenings", "ring {phone 01 55 50 12 34} demain", "tel. {phone 0049-30-5550-123} daily",
    "telephone {phone 91 555 01 23} hoy", "phone {phone 555 010 7788} please", "call me at {phone (555)010-4411} tonight", "whatsapp {phone 0049 171 5550123}",
    "server {ip 10[.]0[.]4[.]17} is down", "host {ip 192[.]168[.]1[.]20} blocked", "from ip {ip 172-16-0-9} at night", "address {ip 10,0,0,8} answered", "ip {ip 203[.]0[.]113[.]5} seen",
    "card {card 4111.1111.1111.1111} expired", "visa {card 4012/8888/8888/1881} charged", "card number {card 5500_0000_0000_0004} ok", "pay with {card 4111,1111,1111,1111} here",
    "order 123456789 was shipped on 2024-01-15", "invoice 2023/00471 over 1,299.00 euro", "version 3.14.15 and 2.0.1 differ", "in 1999 and 2004 there were 120 cases",
    "at 10:30 on 12.05.2021 the train left", "part no 55-2201-B costs 17.50", "pages 110-115 of volume 12", "isbn 978-3-16-148410-0 in print", "the score was 3-2 after 90 minutes",
    "commit 9fceb02d0ae598e95dc970b74767f19372d61af8 broke it", "token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "about 47853805923 stars ### 12345678901 ###", "room 12 floor 3 building 7",
    "from 1 to 20,000 words in 4 languages", "section 4.2.1 table 7", "latitude 52.5200 longitude 13.4050", "see chapter 10 (at) the end", "meet me (at) noon today", "weight 70.5 kg height 1.80 m",
    "a@b is no address", "user @anna wrote 3 posts", "id 550e8400-e29b-41d4-a716-446655440000", "1 2 3 4 5 6 7 8 9 10", "2020-12-31T23:59:59Z 17 ms", "price 12.000.000 in total", "x 4111 y 1111",
)
_CUES = frozenset("mail email e-mail contact call tel phone fax mobile ring telephone whatsapp server host ip address from card visa number pay with order invoice version isbn part token commit write send reach id at".split())
_BRACKET = re.compile(rb"[(\[](?:at|dot)[)\]]", re.I)


def labelled_table(spark: SparkSession) -> DataFrame:
    """The built-in sentences as a table: sentence, position, token, label."""
    return spark.createDataFrame([(s, p, t, k) for s, line in enumerate(SENTENCES) for p, (t, k) in enumerate(_tagged(line))], "sentence int, position int, token string, label string")


def _tagged(line: str) -> list[tuple[str, str]]:
    out = []
    for piece in re.findall(r"\{[^}]*\}|[^\s{}]+", line):
        words = piece.strip("{}").split()
        out += [(w, words[0]) for w in words[1:]] if piece.startswith("{") else [(piece, "none")]
    return out


def shape(token: str) -> str:
    """Runs of letters as a, of digits as 9, other characters as they are; at most 16 characters."""
    return re.sub("9+", "9", re.sub("[0-9]", "9", re.sub(r"[^\W\d_]+", "a", token[:200])))[:16]


def _features(tokens: list[str], i: int) -> list[str]:
    token = tokens[i]
    digits = sum(c.isdigit() for c in token)

    def near(k: int) -> str:
        if not 0 <= i + k < len(tokens):
            return "|"
        word = tokens[i + k].strip(".,;:!?()[]").lower()
        return word if word in _CUES else shape(tokens[i + k])[:6]

    bucket = digits if digits < 5 else min(20, digits // 3 * 3)
    # in the words (at) and (dot) the brackets are the message
    word = token.lower() if _BRACKET.fullmatch(token.encode()) else ""
    return [f"s={shape(token)}", f"n={bucket}", f"w={word}", f"s,p={shape(token)},{near(-1)}", f"p={near(-1)}", f"q={near(-2)}", f"f={near(1)}", f"n,f={bucket},{shape(tokens[i + 1])[:6] if i + 1 < len(tokens) else '|'}",
            f"n,p={bucket},{near(-1)}", f"@={'@' in token},{'.' in token.rpartition('@')[2]}"]


@dataclass
class Field:
    """Weights per feature and label, and of the steps from label to label; before and after a chain stands label 0."""

    numbers: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def emission(self, tokens: list[str], i: int) -> np.ndarray:
        found = [self.numbers[f] for f in _features(tokens, i) if f in self.numbers]
        return self.weights[found].sum(axis=0) if found else np.zeros(len(_LABELS))

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many chains of emissions at once, those of similar length together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        order = sorted(range(len(chains)), key=lambda c: len(chains[c]))
        low = 0
        while low < len(order):
            high = low + 1
            while high < len(order) and (high - low + 1) * len(chains[order[high]]) <= 20_000:
                high += 1
            part = order[low:high]
            for chain, path in zip(part, self._viterbi([chains[c] for c in part])):
                out[chain] = path
            low = high
        return out

    def _viterbi(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(c) for c in chains])
        longest = int(sizes.max())
        held = np.zeros((len(chains), longest, len(_LABELS)))
        for i, chain in enumerate(chains):
            held[i, : len(chain)] = chain
        best, back = held[:, 0] + self.steps[0], np.zeros(held.shape, np.int8)
        for t in range(1, longest):
            ways = best[:, :, None] + self.steps
            back[:, t] = ways.argmax(axis=1)
            best = np.where((t < sizes)[:, None], ways.max(axis=1) + held[:, t], best)
        label = (best + self.steps[:, 0]).argmax(axis=1)
        paths = np.zeros((len(chains), longest), np.int64)
        for t in range(longest - 1, -1, -1):
            inside = t < sizes
            paths[inside, t] = label[inside]
            if t:
                label = np.where(inside, back[np.arange(len(chains)), t, label], label)
        return [p[:n] for p, n in zip(paths, sizes)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sentences: list[list[tuple[str, str]]], rounds: int = 150, ridge: float = 0.02) -> Field:
    """Adam on the penalised log-likelihood, gradients by forward and backward sums over all sentences at once."""
    tokens = [[t for t, _ in s] for s in sentences]
    gold = [np.array([_LABELS.index(k) for _, k in s]) for s in sentences]
    found = [[_features(t, i) for i in range(len(t))] for t in tokens]
    numbers = {f: i for i, f in enumerate(sorted({f for s in found for x in s for f in x}))}
    n, longest, labels = len(sentences), max((len(t) for t in tokens), default=0), len(_LABELS)
    field = Field(numbers, np.zeros((len(numbers), labels)), np.zeros((labels, labels)))
    if not n:
        return field
    sizes = np.array([len(t) for t in tokens])
    used = np.zeros((n, longest, len(numbers)), np.float32)
    truth = np.zeros((n, longest, labels))
    steps_seen = np.zeros((labels, labels))
    for i, s in enumerate(found):
        for t, names in enumerate(s):
            used[i, t, [numbers[f] for f in names]] = 1
            truth[i, t, gold[i][t]] = 1
        path = [0, *gold[i], 0]
        np.add.at(steps_seen, (path[:-1], path[1:]), 1)
    flat, inside = used.reshape(-1, len(numbers)), np.arange(longest) < sizes[:, None]
    values = [field.weights, field.steps]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for r in range(1, rounds + 1):
        held = (flat @ field.weights).reshape(n, longest, labels)
        forward, backward = np.zeros_like(held), np.zeros_like(held)
        forward[:, 0] = held[:, 0] + field.steps[0]
        for t in range(1, longest):
            forward[:, t] = np.where(inside[:, t, None], _logsum(forward[:, t - 1, :, None] + field.steps, 1) + held[:, t], forward[:, t - 1])
        total = _logsum(forward[:, -1] + field.steps[:, 0], 1)
        backward[:] = field.steps[:, 0]
        for t in range(longest - 2, -1, -1):
            following = _logsum(field.steps + (held[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(inside[:, t + 1, None], following, field.steps[:, 0])
        share = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
        moved = np.zeros((labels, labels))
        moved[0] += share[:, 0].sum(axis=0)
        moved[:, 0] += share[np.arange(n), sizes - 1].sum(axis=0)
        for t in range(1, longest):
            both = forward[:, t - 1, :, None] + field.steps + (held[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            moved += (np.exp(both) * inside[:, t, None, None]).sum(axis=0)
        slopes = [flat.T @ (share - truth).reshape(-1, labels) + ridge * field.weights, moved - steps_seen + ridge * field.steps]
        for value, slope, (first, second) in zip(values, slopes, moments):
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            value -= 0.1 * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
    return field


def train(table: DataFrame, most_rows: int = 20_000) -> Field:
    """Fits on the first ``most_rows`` rows of a labelled table (sentence, position, token, label); rows with nulls are left out."""
    rows = table.dropna(subset=["sentence", "position", "token", "label"]).orderBy("sentence", "position").limit(most_rows).collect()
    sentences: dict = {}
    for r in rows:
        sentences.setdefault(r.sentence, []).append((r.token, r.label))
    return fit(list(sentences.values()))


_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: the run is taken whole by the first group or not at all.
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _digits(found: bytes) -> str:
    return re.sub(r"[^0-9]", "", found.decode("ascii", "replace"))


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    """From each @ leftwards over local characters, but not into the last match; then the domain."""
    free, at = 0, text.find(b"@")
    while at >= 0:
        reach = 64
        while True:
            part = text[max(free, at - reach) : at]
            kept = len(part) - len(part.rstrip(_LOCAL))
            if kept < len(part) or at - reach <= free:
                break
            reach *= 2
        following = _DOMAIN.match(text, at) if kept else None
        if following:
            yield at - kept, following.end()
            free = following.end()
        at = text.find(b"@", max(free, at + 1))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes of what the fixed patterns find, by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b"."))]
    for m in _CARD.finditer(text):
        number = _digits(m[0])
        if 12 <= len(number) <= 19 and luhn(number):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


_WRITTEN_EMAIL = re.compile(r"[\w.%+-]+\s*(?:@|[(\[]at[)\]])\s*[\w-]+(?:\s*(?:\.|[(\[]dot[)\]])\s*[\w-]+)*", re.I)


def _plausible(kind: int, found: str) -> bool:
    """What a span of that kind must hold whatever the field says."""
    digits = re.sub("[^0-9]", "", found)
    if kind == 1:
        return bool(_WRITTEN_EMAIL.fullmatch(found))
    if kind == 2:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 3:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def _chains(active: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of active words; all others can only have label 0, so the runs are decoded on their own without loss."""
    at = np.flatnonzero(active)
    if len(at):
        cuts = np.flatnonzero(np.diff(at) > 1)
        yield from zip(at[np.concatenate(([0], cuts + 1))].tolist(), (at[np.concatenate((cuts, [len(at) - 1]))] + 1).tolist())


class _Text:
    """One text that has a digit, an @ or a bracketed word: its spans and its chains of emissions."""

    def __init__(self, text: bytes, field: Field):
        self.text = text
        self.base = base_spans(text)
        data = np.frombuffer(text, np.uint8)
        inside = SPACE_WORDS[data] != 0
        self.starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        self.ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
        marks = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
        active = np.zeros(len(self.starts), bool)
        active[np.searchsorted(self.starts, marks, "right") - 1] = True
        for m in _BRACKET.finditer(text):
            word = int(np.searchsorted(self.starts, m.start(), "right")) - 1
            active[max(0, word - 1) : word + 2] = True
        self.runs = list(_chains(active))
        self.emissions = [self._emissions(field, low, high) for low, high in self.runs]

    def _emissions(self, field: Field, low: int, high: int) -> np.ndarray:
        first = max(0, low - 2)
        tokens = [self.text[a:b].decode("utf-8", "replace") for a, b in zip(self.starts[first : high + 2].tolist(), self.ends[first : high + 2].tolist())]
        return np.stack([field.emission(tokens, i) for i in range(low - first, high - first)])

    def added(self, paths: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """Spans of the field that are plausible and touch no base span."""
        out = []
        for (low, _), path in zip(self.runs, paths):
            for start, stop in _same(path):
                kind = int(path[start])
                if not kind:
                    continue
                a, b = int(self.starts[low + start]), int(self.ends[low + stop - 1])
                piece = self.text[a:b]
                head = len(piece) - len(piece.lstrip(b".,;:!?\"'<>{}#*&$%" + (b"" if kind == 4 else b"([")))
                tail = len(piece) - len(piece.rstrip(b".,;:!?\"'<>{}#*&$%" + (b"" if kind == 1 else b")]")))
                a, b = a + head, b - tail
                if a < b and _plausible(kind, self.text[a:b].decode("utf-8", "replace")) and not any(x < b and a < y for x, _, y in self.base):
                    out.append((a, kind - 1, b))
        return out

    def positions(self, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Byte offsets as code points."""
        if not spans or self.text.isascii():
            return spans
        upto = np.concatenate(([0], np.cumsum((np.frombuffer(self.text, np.uint8) & 0xC0) != 0x80)))
        return [(int(upto[a]), k, int(upto[b])) for a, k, b in spans]


def _same(path: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return zip(cuts[:-1], cuts[1:])


FOUND_SQL = "base array<struct<kind:string,start:bigint,stop:bigint>>, added array<struct<kind:string,start:bigint,stop:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def _scan_batch(batch: pa.RecordBatch, field: Field) -> pa.RecordBatch:
    data, offsets = utf8(batch.column(1))
    marked = (data >= 48) & (data <= 57) | (data == 64) | (data == 40) | (data == 91)
    upto = np.concatenate(([0], np.cumsum(marked)))
    texts = {}
    for i in np.flatnonzero(upto[offsets[1:]] > upto[offsets[:-1]]).tolist():
        texts[i] = _Text(data[offsets[i] : offsets[i + 1]].tobytes(), field)
    paths = iter(field.decode([e for t in texts.values() for e in t.emissions]))
    base: list[list] = [[] for _ in range(batch.num_rows)]
    added: list[list] = [[] for _ in range(batch.num_rows)]
    for i, text in texts.items():
        more = text.added([next(paths) for _ in text.runs])
        base[i] = [{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in text.positions(text.base)]
        added[i] = [{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in text.positions(more)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPAN), pa.array(added, _SPAN)], names=["doc_id", "base", "added"])


def find(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans of every whole text, in code points: ``base`` by the fixed patterns, ``added`` by the field where base has nothing.

    Words without a digit or @ that stand beside no bracketed "at" or "dot" can only have label none; the runs between them
    are chains of their own, decoded in batches. Null and empty texts have no spans; repeated rows are each scanned; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scan_batch(batch, field)

    kind = dict(rows.dtypes)["doc_id"]
    return map_arrow(rows, run, f"doc_id {kind}, {FOUND_SQL}").withColumnRenamed("doc_id", id_column)


def scan(docs: DataFrame, field: Field | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``find`` as counts per kind of base spans, a digest of them, and all spans as text."""
    found = find(docs, field or train(labelled_table(docs.sparkSession)), id_column, text_column)
    kinds = F.array(*map(F.lit, KINDS))

    def told(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]).alias("k"), s["stop"], s["kind"])))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(id_column, *map(count, KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"),
                        told(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
