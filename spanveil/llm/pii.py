"""Personal data: spans by patterns, and those that a character-level network adds."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.base import whole
from spanveil.llm.pii_model import KINDS, Network, classes, luhn, trained

#: Windows start every STRIDE code points and overlap by half.
WINDOW, STRIDE = 160, 80
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no start inside a run of digits: such a match would have begun before, or fails for the same reason
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|::")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def octet(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    plain = digits.lstrip("0")
    return len(plain) < 3 or (len(plain) == 3 and plain <= "255")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind's pattern that its test lets pass."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not _HINT.search(text):
        return found
    found["email"] = emails(text)
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


_AT, _DOT = re.compile(r"[\[(]?@[\])]?"), re.compile(r"[\[(]?\.[\])]?")
_GROUPS = re.compile(r"[0-9]+(?: ?[\[(]?\.[\])]? ?[0-9]+){3}")
_CARD_MARKS, _CALL_MARKS = frozenset("0123456789 ./-"), frozenset("0123456789 ()./-+")


def plausible(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a span of the network can be what it is said to be: its shape and checksum, not its surroundings."""
    own = text[start:end]
    if end <= start or (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    if kind == "email":
        local, *domain = _AT.split(own)
        return len(domain) == 1 and bool(local.strip()) and len(_DOT.split(domain[0])) > 1 and all(x.strip() for x in _DOT.split(domain[0])) and any(c.isalpha() for c in domain[0])
    if kind == "ip":
        if _GROUPS.fullmatch(own):
            return all(octet(x) for x in re.findall("[0-9]+", own))
        try:
            return own.count(":") >= 2 and sum(c.isalnum() for c in own) > 1 and len(own) < 46 and bool(ipaddress.IPv6Address(own))
        except ValueError:
            return False
    digits = [c for c in own if c in "0123456789"]
    if kind == "card":
        return {*own} <= _CARD_MARKS and 13 <= len(digits) <= 19 and luhn("".join(digits))
    return {*own} <= _CALL_MARKS and 8 <= len(digits) <= 15 and len(digits) < len(own)


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit, an @ or two colons, as every span does that the network is taught."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    found: set[int] = set()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    hit = ((codes >= 48) & (codes < 58)) | (codes == 64)
    hit[1:] |= (codes[1:] == 58) & (codes[:-1] == 58)
    at = np.unique(np.flatnonzero(hit) // STRIDE)
    found.update(np.minimum(at, last).tolist(), np.minimum(np.maximum(at - 1, 0), last).tolist())
    return sorted(x * STRIDE for x in found)


@dataclass
class Fragment:
    """What one window shows of a span, with the gain of each character; open where the window ends within it."""

    kind: str
    start: int
    end: int
    gain: np.ndarray
    open_left: bool
    open_right: bool


def put_together(found: list[Fragment]) -> dict[tuple[str, int, int], float]:
    """The spans that fragments of all windows of a text make, with their weights.

    Fragments of one kind are one span where one of them is open and the other lies over
    or next to its open end. A character weighs the mean of what the windows give it.
    The same span seen whole by two windows weighs what both give it.
    """
    spans: dict[tuple[str, int, int], float] = {}
    for kind in KINDS:
        group: list[Fragment] = []
        for f in [*sorted((f for f in found if f.kind == kind), key=lambda f: (f.start, f.end)), None]:
            reach = max((g.end for g in group), default=0)
            if f is not None and group and (f.start <= max((g.end for g in group if g.open_right), default=-1) or (f.open_left and f.start <= reach)):
                group.append(f)
                continue
            if group:
                first = min(g.start for g in group)
                total, times = np.zeros(reach - first), np.zeros(reach - first)
                for g in group:
                    total[g.start - first : g.end - first] += g.gain
                    times[g.start - first : g.end - first] += 1
                weight = float((total / np.maximum(times, 1)).sum())
                spans[kind, first, reach] = max(weight, spans.get((kind, first, reach), weight))
            group = [f] if f is not None else []
    return spans


def reconciled(spans: dict[tuple[str, int, int], float]) -> list[tuple[str, int, int]]:
    """Of the spans of all windows of a text, those that do not overlap and weigh most together."""
    order = sorted(spans, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for i, s in enumerate(order):
        before = bisect_right(ends, s[1], 0, i)
        best.append(max((best[i][0], 0), (best[before][0] + spans[s], 1)))
    out, i = [], len(order)
    while i:
        if best[i][1]:
            out.append(order[i - 1])
            i = bisect_right(ends, order[i - 1][1], 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def trimmed(kind: str, text: str, start: int, end: int) -> int:
    """The end of a span without the marks that follow it in a sentence."""
    while end > start and text[end - 1] in " .,;:\n|)" and not (kind == "phone" and text[end - 1] == ")"):
        end -= 1
    return end


def added_spans(texts: list[str], net: Network, size: int = 512) -> list[list[tuple[str, int, int]]]:
    """Per text, the plausible spans of the network.

    Windows overlap by half and are decoded one by one; a window next to one that ends
    within a span is decoded too. Then the fragments of all windows of a text are put
    together, and of the spans that these make, those stay that do not overlap and weigh
    most together.
    """
    found: list[list[Fragment]] = [[] for _ in texts]
    seen: list[set[int]] = [{*windows(text)} if _HINT.search(text) else set() for text in texts]
    todo = [(n, at) for n, own in enumerate(seen) for at in sorted(own)]
    while todo:
        some, todo = todo[:size], todo[size:]
        chars = np.zeros((len(some), WINDOW), np.int64)
        for i, (n, at) in enumerate(some):
            own = classes(texts[n][at : at + WINDOW])
            chars[i, : len(own)] = own
        tags, gain = net.decode(chars)
        for i, j in zip(*np.nonzero(tags % 2 == 1), strict=True):
            n, at = some[i]
            stop = j + 1
            while stop < WINDOW and tags[i, stop] == tags[i, j] + 1:
                stop += 1
            start, end = at + int(j), min(at + int(stop), len(texts[n]))
            if start < end:
                left, right = start == at and at > 0, end == at + WINDOW and end < len(texts[n])
                found[n].append(Fragment(KINDS[tags[i, j] // 2], start, end, gain[i, j : j + end - start], left, right))
                for more in [at - STRIDE] * left + [at + STRIDE] * right:
                    if more not in seen[n]:
                        seen[n].add(more)
                        todo.append((n, more))
    out = []
    for text, own in zip(texts, found, strict=True):
        spans = {(k, a, trimmed(k, text, a, b)): w for (k, a, b), w in put_together(own).items() if w > 0} if own else {}
        out.append(reconciled({s: w for s, w in spans.items() if plausible(s[0], text, s[1], s[2])}))
    return out


@lru_cache(4)
def network(lines: tuple[str, ...]) -> Network:
    return trained([*lines])


def sample_lines(docs: DataFrame, most: int, text_col: str) -> tuple[str, ...]:
    """Pieces of at most 120 characters without digits or @, from at most `most` texts, as surroundings in training."""
    piece = F.expr(f"substring({text_col}, 1 + cast(pmod(xxhash64({text_col}), greatest(length({text_col}) - 120, 1)) as int), 120)")
    rows = docs.where(F.length(text_col) >= 20).select(F.xxhash64(text_col).alias("h"), F.regexp_replace(piece, "[0-9@]", "").alias("piece")).orderBy("h", "piece").limit(most)
    return tuple(r.piece for r in rows.collect())


def find_pii(docs: DataFrame, most_lines: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) for each row of docs.

    base: matches of the patterns. spans: these, and what the network adds without
    touching one of them: looser forms of the same kinds (an @ in brackets, an address with
    bracketed dots or in version 6, cards of 13 to 15 digits, phone numbers without a plus),
    of any length, each put to a test of its shape and checksum. The network is trained here, from spans made up among pieces of at
    most `most_lines` texts. It reads every window of every text that holds a digit, an @
    or two colons, one of which stands in all that it is taught, and windows next to them.

    Offsets are code points, ends exclusive. Null texts are empty and have none; ids may
    be null or repeat; texts are read whole; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    net = network(sample_lines(rows, most_lines, "text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    told = lambda spans: [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in sorted(spans[k])]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            every = []
            for own, added in zip(base, added_spans(texts, net), strict=True):
                taken, new = [s for k in KINDS for s in own[k]], {k: [*own[k]] for k in KINDS}
                for k, a, b in added:
                    if all(b <= x or y <= a for x, y in taken):
                        new[k].append((a, b))
                every.append(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(told, base), kind), pa.array(map(told, every), kind)], ["doc_id", "base", "spans"])

    each = "array<struct<kind string, start long, end long>>"
    return rows.mapInArrow(run, f"doc_id long, base {each}, spans {each}")


def digest(found: DataFrame) -> DataFrame:
    """Counts, checksum and spelled-out spans of what find_pii gives."""
    spelled = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(written(base_spans(text)).encode()).hexdigest()
