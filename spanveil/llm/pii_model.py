"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
PAD, LETTER, OTHER, VOCABULARY = 0, 128, 129, 130
#: Code points under 128 as the network sees them: all digits alike, letters without case.
_CLASS = np.array([ord("0") if 48 <= c < 58 else ord(chr(c).lower()) for c in range(128)], np.int64)
EMBEDDING, HIDDEN = 10, 32


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    wide = (codes >= 0xC0) & (codes < 0x250) | (codes >= 0x370) & (codes < 0x2000) | (codes >= 0x3040)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], np.where(wide, LETTER, OTHER))


def allowed() -> np.ndarray:
    """From tag (row) to tag (column): inside only after begin or inside of the same kind."""
    ok = np.ones((TAGS, TAGS), np.bool_)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


NEVER = np.where(allowed(), 0.0, -1e4).astype(np.float32)
START = np.array([0.0] + [0.0, -1e4] * len(KINDS), np.float32)


@dataclass
class Network:
    """Weights by name; both directions are stacked in the first axis."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        scale = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
        bias[:, :, HIDDEN : 2 * HIDDEN] = 1  # gates: in, forget, out, candidate
        return cls({"embed": scale(VOCABULARY, EMBEDDING) * 2, "x": scale(2, EMBEDDING, 4 * HIDDEN), "h": scale(2, HIDDEN, 4 * HIDDEN), "b": bias, "out": scale(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)})

    def run(self, chars: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Tag scores (batch, length, tags) of character classes (batch, length)."""
        w, (n, length) = self.w, chars.shape
        both = np.stack([chars, chars[:, ::-1]])
        table = np.stack([w["embed"] @ w["x"][d] + w["b"][d] for d in (0, 1)])
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((length, 2, n, HIDDEN), np.float32)
        for t in range(length):
            z = np.stack([table[0][both[0, :, t]], table[1][both[1, :, t]]]) + h @ w["h"]
            gates = 0.5 * np.tanh(0.5 * z[..., : 3 * HIDDEN]) + 0.5
            new = np.tanh(z[..., 3 * HIDDEN :])
            before = c
            c = gates[..., HIDDEN : 2 * HIDDEN] * c + gates[..., :HIDDEN] * new
            bent = np.tanh(c)
            if keep is not None:
                keep.append((h, before, gates, new, bent))
            h = gates[..., 2 * HIDDEN :] * bent
            out[t] = h
        hidden = np.concatenate([out[:, 0], out[::-1, 1]], axis=2).transpose(1, 0, 2)
        if keep is not None:
            keep.append(hidden)
        return hidden @ w["out"] + w["out_b"]

    def gradient(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        w, (n, length), kept = self.w, chars.shape, []
        score = self.run(chars, kept).astype(np.float64)
        hidden = kept.pop()
        trans = w["trans"].astype(np.float64) + NEVER
        # the CRF's forward and backward sums, scaled to one at each step
        top = score.max(axis=2, keepdims=True)
        step, emit = np.exp(trans), np.exp(score - top).transpose(1, 0, 2)
        alpha, beta, scale = np.empty((length, n, TAGS)), np.ones((length, n, TAGS)), np.empty((length, n, 1))
        for t in range(length):
            alpha[t] = emit[t] * (np.exp(START.astype(np.float64)) if t == 0 else alpha[t - 1] @ step)
            scale[t] = alpha[t].sum(1, keepdims=True)
            alpha[t] /= scale[t]
        for t in range(length - 2, -1, -1):
            beta[t] = (emit[t + 1] * beta[t + 1] / scale[t + 1]) @ step.T
        total = np.log(scale[..., 0]).sum(0) + top[..., 0].sum(1)
        d_score = (alpha * beta).transpose(1, 0, 2)
        rows, at = np.arange(n)[:, None], np.arange(length)[None, :]
        gold = START[tags[:, 0]] + score[rows, at, tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        d_trans = step * (alpha[:-1].reshape(-1, TAGS).T @ (emit[1:] * beta[1:] / scale[1:]).reshape(-1, TAGS))
        np.add.at(d_trans, (tags[:, :-1], tags[:, 1:]), -1)
        d_score[rows, at, tags] -= 1
        d_score = (d_score / n).astype(np.float32)
        g = {"trans": (d_trans / n).astype(np.float32), "out": hidden.reshape(-1, 2 * HIDDEN).T @ d_score.reshape(-1, TAGS), "out_b": d_score.sum((0, 1))}
        # back through time, both directions at once
        d_hidden = d_score @ w["out"].T
        d_out = np.stack([d_hidden[..., :HIDDEN].transpose(1, 0, 2), d_hidden[:, ::-1, HIDDEN:].transpose(1, 0, 2)], 1)
        both = np.stack([chars, chars[:, ::-1]])
        g |= {k: np.zeros_like(w[k]) for k in ("embed", "x", "h", "b")}
        every, back = np.empty((length, 2, n, 4 * HIDDEN), w["h"].dtype), np.ascontiguousarray(w["h"].transpose(0, 2, 1))
        dh = dc = np.zeros((2, n, HIDDEN), w["h"].dtype)
        for t in range(length - 1, -1, -1):
            h, before, gates, new, bent = kept[t]
            i, f, o = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - bent**2)
            dz = every[t]
            dz[..., :HIDDEN] = dc * new
            dz[..., HIDDEN : 2 * HIDDEN] = dc * before
            dz[..., 2 * HIDDEN : 3 * HIDDEN] = dh * bent
            dz[..., : 3 * HIDDEN] *= gates * (1 - gates)
            dz[..., 3 * HIDDEN :] = dc * i * (1 - new**2)
            dh, dc = dz @ back, dc * f
        held = np.stack([k[0] for k in kept])
        for d in (0, 1):
            own = every[:, d].reshape(-1, 4 * HIDDEN)
            g["h"][d] = held[:, d].reshape(-1, HIDDEN).T @ own
            order = np.argsort(both[d].T.ravel(), kind="stable")
            names, starts = np.unique(both[d].T.ravel()[order], return_index=True)
            d_table = np.zeros((VOCABULARY, 4 * HIDDEN), w["h"].dtype)
            d_table[names] = np.add.reduceat(own[order], starts, axis=0)
            g["x"][d] = w["embed"].T @ d_table
            g["b"][d] = d_table.sum(0, keepdims=True)
            g["embed"] += d_table @ w["x"][d].T
        return float((total - gold).mean()), g

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch, length), and by how much each character's tag beats being outside."""
        score, (n, length) = self.run(chars), chars.shape
        trans = self.w["trans"] + NEVER
        best, back = score[:, 0] + START, np.empty((length, n, TAGS), np.int8)
        for t in range(1, length):
            every = best[:, :, None] + trans
            back[t] = every.argmax(1)
            best = every.max(1) + score[:, t]
        tags = np.empty((n, length), np.int64)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags, np.take_along_axis(score, tags[:, :, None], 2)[..., 0] - score[..., 0]


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


class Examples:
    """Labelled spans: made-up personal data, and what resembles it, in lines of text."""

    def __init__(self, seed: int, lines: list[str]):
        self.r, self.lines = random.Random(seed), [x for x in lines if x.strip()] or ["and the other is here", "der Brief kam gestern an"]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        return "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(2, 9)))

    def email(self) -> str:
        r = self.r
        local = self.word() + r.choice(["", ".", "_", "-", "+"]) + r.choice(["", self.word(), self.digits(2)])
        local = local.strip("._-+") if r.random() < 0.8 else local + "é"
        domain = self.word() + r.choice(["", "-" + self.word(), "ü"])
        dots = r.choice([".", ".", ".", " . ", "[.]"])
        at = r.choice(["@", "@", "@", " @ ", "[@]", "(@)"]) if dots == "." else r.choice(["@", " @ "])
        return local + at + domain + "".join(dots + x for x in ([self.word()] if r.random() < 0.3 else []) + [r.choice(["com", "org", "de", "fr", "example", "co"])])

    def ip(self) -> str:
        r = self.r
        if r.random() < 0.25:
            parts = [f"{r.randrange(65536):x}" for _ in range(8)]
            return ":".join(parts) if r.random() < 0.5 else ":".join(parts[: r.randint(1, 3)]) + "::" + ":".join(parts[: r.randint(1, 3)])
        return r.choice([".", ".", ".", "[.]", " . ", "(.)"]).join(str(r.randint(0, 255)) for _ in range(4))

    def card(self) -> str:
        r = self.r
        shape = r.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3)])
        body = r.choice("3456") + self.digits(sum(shape) - 2)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        mark, out = r.choice(["", "", " ", "-", ".", "/"]), []
        for n in shape:
            out, number = [*out, number[:n]], number[n:]
        return mark.join(out)

    def phone(self) -> str:
        r, d = self.r, self.digits
        area = str(r.randint(2, 9)) + d(2)
        return r.choice([
            lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"+{r.randint(1, 99)} {d(r.randint(2, 4))} {d(r.randint(4, 8))}", lambda: f"({area}) {d(3)}-{d(4)}", lambda: f"{area}-{d(3)}-{d(4)}",
            lambda: f"{area}.{d(3)}.{d(4)}", lambda: f"0049 {d(2)} {d(r.randint(6, 8))}", lambda: f"0{r.randint(2, 9)}{d(2)}/{d(r.randint(5, 7))}", lambda: f"0{r.randint(2, 9)}{d(2)} {d(3)} {d(4)}", lambda: f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ])()

    def like(self) -> str:
        r, d = self.r, self.digits
        return r.choice([
            lambda: 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: d(r.randint(1, 12)), lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}",
            lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 999)},{d(3)}.{d(2)}", lambda: f"${r.randint(1, 999)}", lambda: f"{r.randint(1, 300)}-{r.randint(301, 999)}",
            lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{self.word()}-{d(3)}-{d(3)}", lambda: f"https://{self.word()}.org/{d(5)}", lambda: f"{d(2)} %", lambda: "@" + self.word(), lambda: f"{d(3)}x{d(3)}", lambda: f"[{d(2)}]", lambda: f"{d(4)} {self.word()} {d(2)}",
        ])()

    def line(self, length: int) -> tuple[str, list[tuple[int, int, int]]]:
        """A text of so many characters with its spans (kind, start, end)."""
        r, text, spans = self.r, "", []
        while len(text) < length:
            part = r.choice(self.lines)
            at = r.randrange(len(part))
            text += part[at : at + r.randint(3, 40)] + r.choice([" ", " ", " ", "\n", ": ", " | ", " (", ", "])
            x = r.random()
            if x < 0.55:
                kind = r.randrange(len(KINDS))
                own = getattr(self, KINDS[kind])()
                if len(text) + len(own) <= length:
                    spans.append((kind, len(text), len(text) + len(own)))
                    text += own + r.choice([" ", ".", ", ", "\n", ") ", " |", "### "])
            elif x < 0.95:
                text += self.like() + r.choice([" ", ". ", ", ", "\n"])
        return text[:length], spans

    def batch(self, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        chars, tags = np.zeros((n, length), np.int64), np.zeros((n, length), np.int64)
        for i in range(n):
            text, spans = self.line(length if self.r.random() < 0.8 else self.r.randint(20, length))
            chars[i, : len(text)] = classes(text)
            for kind, start, end in spans:
                tags[i, start] = 1 + 2 * kind
                tags[i, start + 1 : end] = 2 + 2 * kind
        return chars, tags


def trained(lines: list[str], steps: int = 600, size: int = 32, length: int = 100, seed: int = 11) -> Network:
    """A network fitted by Adam on labelled spans among these lines; the same for the same lines."""
    net, examples = Network.fresh(seed), Examples(seed, lines)
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        _, g = net.gradient(*examples.batch(size, length))
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        rate = 0.02 * min(1.0, step / 20) * (0.05 + 0.95 * (1 - step / steps))
        for k, x in g.items():
            x = x * min(1.0, 5 / (norm + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
            net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net
