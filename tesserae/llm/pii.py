"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions for what patterns miss.

The network is trained in numpy from labelled spans: short texts, made here by a seeded generator, that hold
e-mail addresses, IP numbers, card and phone numbers as written by people who avoid patterns (`name at host dot
com`, `(555) 123-4567`, `10[.]0[.]0[.]1`, cards in groups parted by dots), and look-alikes that aren't (dates, versions, hex
tokens, prices). Tags are begin/inside of each kind and outside.

A found span must hold a digit or an `@`, or `at`/`dot` in any case between brackets or white space; so text far from any of
these needs no network. Windows of WINDOW characters overlap by half around such places. Their emissions are averaged with
weights that favour a window's middle, and one Viterbi pass over each run of windows
decodes it as a whole, so that no span is cut or told twice at a window's edge. A span of the
network, grown to the ends of its words, is kept if it passes its kind's plain check and overlaps no pattern's span, unless it takes in one of its own kind whole.

The patterns' spans always stay: leftmost, non-overlapping for each kind, and those that fail their check are dropped.

Defined results: null is the empty text, without spans; offsets count code points, ends are exclusive; repeated rows and null ids
are ordinary rows; an empty table gives an empty one; extra columns are ignored. Whole texts are read; a
long one takes time in proportion.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, slices

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, size of embedding and of each direction's state; batches, texts of a batch and step size of the training, texts in all.
WINDOW, EMBEDDING, HIDDEN, STEPS, BATCH, RATE, POOL = 48, 12, 24, 500, 64, 0.02, 12_000
#: Characters kept around the stretches that a place calls for, on each side; characters of a piece of a long run, and of its margins.
REACH, PIECE, MARGIN = 24, 4096, 192
TAGS = 1 + 2 * len(KINDS)

# --- patterns -------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # inside a run of digits nothing matches that doesn't from its start
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        at += 1
        if domain:
            done = at = domain.end()
            yield begin, done


def patterns(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end), by kind and start."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return found


def _plain_check(kind: str, text: str) -> bool:
    """What any span of a kind must hold, however it's written."""
    digits = _DIGITS.sub("", text)
    if kind == "email":
        dots = r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\sdot\s)"
        if re.search(r"(?i)\sat\s", text):  # two plain words make an address only with the other one
            dots = r"\sdot\s"
        return bool(re.fullmatch(rf"(?i)[\w.%+-]+(?:\s*(?:@|[\[(]\s*at\s*[\])])\s*|\sat\s)[\w-]+(?:{dots}[\w-]+)+", text))
    if kind == "ip":
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts) and bool(re.fullmatch(r"[0-9]+(?:\s*[\[(]?\s*(?:\.|dot)\s*[\])]?\s*[0-9]+){3}", text))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,2}[0-9])+", text))
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"(?:\+|00)?[ (]*[0-9][ ()./0-9-]*[0-9]", text)) and bool(re.search(r"[ ()./-]", text)) and not re.search(r"[0-9]{9}", text)


#: An address as `_plain_check` takes it, within more text.
_WRITTEN = re.compile(r"(?i)(?<![\w.%+-])[\w.%+-]++(?:\s*(?:@|[\[(]\s*at\s*[\])])\s*[\w-]++(?:(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\sdot\s)[\w-]++)+|\sat\s[\w-]++(?:\sdot\s[\w-]++)+)")

# --- labelled spans -------------------------------------------------------------------------


class Texts:
    """Seeded texts of WINDOW characters with tags."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def pick(self, *of: str) -> str:
        return self.random.choice(of)

    def digits(self, n: int) -> str:
        return "".join(self.random.choices("0123456789", k=n))

    def word(self) -> str:
        return "".join(self.pick("th", "an", "er", "ing", "on", "ed", "re", "ble", "es", "ou", "a", "é", "ü", "ción", "sch", "at", "st", "ment") for _ in range(self.random.randrange(1, 4)))

    def entity(self, kind: str) -> str:
        n = lambda: str(self.random.randrange(0, 256))
        if kind == "email":
            name, host = self.word() + self.pick("", ".", "_") + self.digits(self.random.randrange(0, 3)), self.word().replace("é", "e") + self.digits(self.random.randrange(0, 2))
            at, dot = self.pick(("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."), ("[at]", "[dot]"))
            return name + at + host + dot + self.pick("com", "org", "net", "example" + dot + "com")
        if kind == "ip":
            return self.pick(".", "[.]", ".", " . ", "(dot)").join(n() for _ in range(4))
        if kind == "card":
            while not luhn(digits := self.pick("3", "4", "5", "6") + self.digits(15)):
                pass
            return self.pick("", " ", "-", ".", "/").join(digits[i : i + 4] for i in range(0, 16, 4))
        return self.pick("+1 ({0}) {1}-{2}", "({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "+44 {0} {1} {2}", "00{3} {0} {1} {2}", "{0}/{1}-{2}").format(self.digits(3), self.digits(3), self.digits(4), self.digits(2))

    def other(self) -> str:
        hexes = "".join(self.pick(*"0123456789abcdef") for _ in range(self.random.randrange(8, 41)))
        return self.pick(f'token = "{hexes}"', hexes, f"20{self.digits(2)}-{self.digits(2)}-{self.digits(2)}", f"{self.digits(2)}:{self.digits(2)}:{self.digits(2)}", f"v{self.digits(1)}.{self.digits(1)}.{self.digits(1)}", f"${self.digits(3)}.{self.digits(2)}", self.digits(self.random.randrange(1, 8)), f"version {self.digits(1)}", f"{self.digits(1)},{self.digits(3)},{self.digits(3)}", f"#{self.digits(5)}", f"{self.digits(2)}/{self.digits(2)}/20{self.digits(2)}", self.digits(12), f"@{self.word()}", f"{self.digits(3)} - {self.digits(3)}")

    def sample(self) -> tuple[str, np.ndarray]:
        """WINDOW characters; some texts begin or end within it, beside padding (`\0`, outside)."""
        text, tags = "", []
        while len(text) < WINDOW + 40:
            what = self.random.random()
            if what < 0.26:
                k = self.random.randrange(len(KINDS))
                piece = self.entity(KINDS[k])
                tags += [1 + 2 * k] + [2 + 2 * k] * (len(piece) - 1)
            else:
                piece = self.other() if what < 0.4 else self.word() if what < 0.92 else self.pick(".", ",", "!!", "###", "\n", "***", ":")
                if self.random.random() < 0.2:
                    piece = self.pick(piece.capitalize(), piece.upper())
                tags += [0] * len(piece)
            text += piece
            if self.random.random() < 0.95:
                more = self.pick(" ", " ", " ", " ", ". ", ", ", "\n")
                text, tags = text + more, [*tags, *[0] * len(more)]
        edge = self.random.random()
        if edge < 0.2:  # padding before
            n = self.random.randrange(1, WINDOW - 8)
            return "\0" * n + text[: WINDOW - n], np.array([0] * n + tags[: WINDOW - n])
        if edge < 0.4:  # and after
            n = self.random.randrange(1, WINDOW - 8)
            return text[n - WINDOW :] + "\0" * n, np.array(tags[n - WINDOW :] + [0] * n)
        cut = self.random.randrange(len(text) - WINDOW)
        return text[cut : cut + WINDOW], np.array(tags[cut : cut + WINDOW])


_MARKS = "@.-+() \n_%/:,[]=\"$#*!&?"
SYMBOLS = 3 + 26 + 10 + len(_MARKS)


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of each ASCII character; 0 pads, 1 is another letter, 2 anything else."""
    out = np.full(128, 2, np.int64)
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = 3 + i
    out[48:58] = np.arange(29, 39)
    out[0] = 0
    for i, c in enumerate(_MARKS):
        out[ord(c)] = 39 + i
    return out


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _symbols()[np.minimum(points, 127)], 1)


# --- network --------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * x.dtype.type(0.5)) * x.dtype.type(0.5) + x.dtype.type(0.5)


class Network:
    """Parameters by name; forward, loss with gradients, Adam. The two directions' weights are stacked, and run together."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        m = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
        bias[:, :, HIDDEN : 2 * HIDDEN] = 1  # forget gates begin open
        self.p = {"embed": m(SYMBOLS, EMBEDDING) * 3, "x": m(2, EMBEDDING, 4 * HIDDEN), "h": m(2, HIDDEN, 4 * HIDDEN), "b": bias, "out": m(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}

    def _states(self, x: np.ndarray, tape: list | None) -> np.ndarray:
        """States (time, direction, text, HIDDEN) over x (time, text, EMBEDDING); each direction in its own order of time."""
        time, n, p = len(x), x.shape[1], self.p
        both = np.stack([x, x[::-1]]).reshape(2, time * n, EMBEDDING)
        into = (both @ p["x"] + p["b"]).reshape(2, time, n, 4 * HIDDEN)
        h = c = np.zeros((2, n, HIDDEN), x.dtype)
        out = np.empty((time, 2, n, HIDDEN), x.dtype)
        for t in range(time):
            gates = h @ p["h"]
            gates += into[:, t]
            act = _sigmoid(gates[:, :, : 3 * HIDDEN])
            i, f, o, g = act[:, :, :HIDDEN], act[:, :, HIDDEN : 2 * HIDDEN], act[:, :, 2 * HIDDEN :], np.tanh(gates[:, :, 3 * HIDDEN :])
            before_h, before_c = h, c
            c = f * c + i * g
            s = np.tanh(c)
            h = out[t] = o * s
            if tape is not None:
                tape.append((before_h, before_c, i, f, o, g, s))
        return out

    def emissions(self, symbols: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """(text, time) symbols to (time, text, TAGS) scores."""
        x = self.p["embed"][symbols.T]
        steps: list | None = [] if tape is not None else None
        out = self._states(x, steps)
        both = np.concatenate([out[:, 0], out[::-1, 1]], 2)
        if tape is not None:
            tape |= {"x": x, "both": both, "steps": steps}
        return both @ self.p["out"] + self.p["out_b"]

    def gradients(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the CRF, and its gradients."""
        p, tape = self.p, {}
        e = self.emissions(symbols, tape)
        time, n = e.shape[:2]
        y = tags.T
        each = np.arange(n)
        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[0] = p["first"] + e[0]
        for t in range(1, time):
            s = forward[t - 1][:, :, None] + p["step"]
            top = s.max(1, keepdims=True)
            forward[t] = np.log(np.exp(s - top).sum(1)) + top[:, 0] + e[t]
        for t in range(time - 2, -1, -1):
            s = p["step"] + (e[t + 1] + backward[t + 1])[:, None]
            top = s.max(2, keepdims=True)
            backward[t] = np.log(np.exp(s - top).sum(2)) + top[:, :, 0]
        top = forward[-1].max(1)
        z = np.log(np.exp(forward[-1] - top[:, None]).sum(1)) + top
        de = np.exp(forward + backward - z[None, :, None])
        score = p["first"][y[0]] + e[np.arange(time)[:, None], each, y].sum(0)
        g = {"first": de[0].sum(0), "step": np.zeros((TAGS, TAGS))}
        np.subtract.at(g["first"], y[0], 1)
        for t in range(1, time):
            g["step"] += np.exp(forward[t - 1][:, :, None] + p["step"] + (e[t] + backward[t])[:, None] - z[:, None, None]).sum(0)
            np.subtract.at(g["step"], (y[t - 1], y[t]), 1)
            score = score + p["step"][y[t - 1], y[t]]
        de[np.arange(time)[:, None], each, y] -= 1
        de = de.astype(e.dtype)
        g["out"], g["out_b"] = np.tensordot(tape["both"], de, ([0, 1], [0, 1])), de.sum((0, 1))
        dboth = de @ p["out"].T
        dh_out = np.stack([dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]], 1)
        dgates = np.empty((time, 2, n, 4 * HIDDEN), e.dtype)
        dh = dc = np.zeros((2, n, HIDDEN), e.dtype)
        back = p["h"].transpose(0, 2, 1).copy()
        for t in range(time - 1, -1, -1):
            before_h, before_c, i, f, o, gg, s = tape["steps"][t]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - s * s)
            d = dgates[t]
            d[:, :, :HIDDEN] = dc * gg * i * (1 - i)
            d[:, :, HIDDEN : 2 * HIDDEN] = dc * before_c * f * (1 - f)
            d[:, :, 2 * HIDDEN : 3 * HIDDEN] = dh * s * o * (1 - o)
            d[:, :, 3 * HIDDEN :] = dc * i * (1 - gg * gg)
            dh, dc = d @ back, dc * f
        flat = dgates.transpose(1, 0, 2, 3).reshape(2, time * n, 4 * HIDDEN)
        before = np.stack([step[0] for step in tape["steps"]], 1).reshape(2, time * n, HIDDEN)
        x = np.stack([tape["x"], tape["x"][::-1]]).reshape(2, time * n, EMBEDDING)
        g["h"], g["x"], g["b"] = before.transpose(0, 2, 1) @ flat, x.transpose(0, 2, 1) @ flat, flat.sum(1, keepdims=True)
        dx = (flat @ p["x"].transpose(0, 2, 1)).reshape(2, time, n, EMBEDDING)
        dx = dx[0] + dx[1, ::-1]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], symbols.T, dx)
        return float((z - score).mean()), {name: v / n for name, v in g.items()}

    def fit(self, texts: Texts, steps: int = STEPS) -> None:
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        pool = [texts.sample() for _ in range(POOL)]
        symbols, tags = np.stack([codes(t) for t, _ in pool]), np.stack([y for _, y in pool])
        for step in range(1, steps + 1):
            batch = texts.random.choices(range(len(pool)), k=BATCH)
            _, g = self.gradients(symbols[batch], tags[batch])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags (run, time) of emissions (run, time, TAGS), by Viterbi."""
        n, time = e.shape[:2]
        back = np.empty((time, n, TAGS), np.int8)
        best = self.p["first"] + e[:, 0]
        for t in range(1, time):
            s = best[:, :, None] + self.p["step"]
            back[t] = s.argmax(1)
            best = s.max(1) + e[:, t]
        tags = np.empty((n, time), np.int8)
        tags[:, -1] = best.argmax(1)
        for t in range(time - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags


def _fit(seed: int, steps: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                network = Network(seed)
                network.fit(Texts(seed), steps)
                yield pa.RecordBatch.from_arrays([pa.array(list(network.p), pa.string()), pa.array([list(v.shape) for v in network.p.values()], pa.list_(pa.int64())), pa.array([v.astype("<f4").tobytes() for v in network.p.values()], pa.binary())], ["name", "shape", "raw"])

    return run


def trained(spark: SparkSession, seed: int = 7, steps: int = STEPS) -> Network:
    """The network, trained once a session, in a task: a lost executor costs a retry, and the driver no time of its own."""
    sc = spark.sparkContext
    known = sc.__dict__.setdefault("_tesserae_networks", {})
    if (seed, steps) not in known:
        ship(spark)
        network = Network(seed)
        for r in spark.range(0, 1, 1, 1).mapInArrow(_fit(seed, steps), "name string, shape array<long>, raw binary").collect():
            network.p[r["name"]] = np.frombuffer(bytes(r["raw"]), "<f4").reshape(r["shape"])
        known[seed, steps] = network
    return known[seed, steps]


# --- windows --------------------------------------------------------------------------------

_CALL = re.compile(r"[0-9@]|(?<=[\[(\s])(?:at|dot)(?=[\])\s])", re.IGNORECASE)
#: Characters of any span but blanks, letters and digits.
_HELD = frozenset("@()[]/.%+-_")
_HALF = WINDOW // 2
_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def _over(text: str, at: int, step: int) -> int:
    """The place reached from `at`, forwards (1) or backwards (-1), over characters that a span may hold."""
    off = 0 if step > 0 else 1
    while 0 <= at - off < len(text) and (text[at - off] in _HELD or text[at - off].isalnum()):
        at += step
    return at


def _blanks(text: str, at: int, step: int) -> int:
    off = 0 if step > 0 else 1
    while 0 <= at - off < len(text) and text[at - off].isspace():
        at += step
    return at


def runs(text: str) -> list[tuple[int, int]]:
    """Ranges around the places that call for the network, joined where they touch.

    The stretch of a call and the two beside it on each side, across blanks, are always whole (a bracket may stand alone between
    an address's words), and REACH characters are kept around them.
    """
    out: list[list[int]] = []
    end = -1  # of the last call's stretch
    for m in _CALL.finditer(text):
        if m.end() <= end:
            continue
        a, end = _over(text, m.start(), -1), _over(text, m.end(), 1)
        b = end
        for _ in range(2):
            a, b = _over(text, _blanks(text, a, -1), -1), _over(text, _blanks(text, b, 1), 1)
        a, b = max(0, a - REACH), min(len(text), b + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def network_spans(network: Network, texts: list[str], most: int = 4096) -> list[list[tuple[str, int, int]]]:
    """Spans of the network in each text, before any check.

    Long runs are decoded in pieces with margins on both sides, of which a piece has the say about its own characters; so memory
    beside the text is a byte for each character of a run, and no span shorter than a margin is cut.
    """
    where = [(n, a, b) for n, t in enumerate(texts) for a, b in runs(t)]
    tags_of = [np.zeros(b - a, np.int8) for _, a, b in where]
    pieces = [(r, max(a, s - MARGIN), min(b, s + PIECE + MARGIN), s, min(b, s + PIECE)) for r, (_, a, b) in enumerate(where) for s in range(a, b, PIECE)]
    pieces.sort(key=lambda x: x[2] - x[1])
    at = 0
    while at < len(pieces):
        # pieces of like length, a bounded number of windows together
        group, windows = [], 0
        while at < len(pieces) and (not group or windows < most and pieces[at][2] - pieces[at][1] <= 1.3 * (group[0][2] - group[0][1]) + WINDOW):
            group.append(pieces[at])
            windows += (pieces[at][2] - pieces[at][1]) // _HALF + 2
            at += 1
        longest = max(b - a for _, a, b, _, _ in group)
        steps = max(1, -(-longest // _HALF))  # windows begin half a window before the piece and every half
        symbols = np.zeros((len(group), (steps + 1) * _HALF), np.int64)
        for i, (r, a, b, _, _) in enumerate(group):
            symbols[i, _HALF // 2 : _HALF // 2 + b - a][: b - a] = codes(texts[where[r][0]][a:b])[: symbols.shape[1] - _HALF // 2]
        total, weight = np.zeros((*symbols.shape, TAGS), np.float32), np.zeros(symbols.shape[1], np.float32)
        per = max(1, most // len(group))
        for s in range(0, steps, per):
            some = range(s, min(steps, s + per))
            cut = np.concatenate([symbols[:, k * _HALF : k * _HALF + WINDOW] for k in some])
            e = network.emissions(cut).transpose(1, 0, 2)
            for j, k in enumerate(some):
                total[:, k * _HALF : k * _HALF + WINDOW] += e[j * len(group) : (j + 1) * len(group)] * _WEIGHT[:, None]
                weight[k * _HALF : k * _HALF + WINDOW] += _WEIGHT
        total /= np.maximum(weight, 1)[:, None]
        pad = symbols == 0
        total[pad] = -50
        total[pad, 0] = 50  # outside
        tags = network.decode(total)
        for i, (r, a, _, x, y) in enumerate(group):
            begin = where[r][1]
            tags_of[r][x - begin : y - begin] = tags[i, _HALF // 2 + x - a : _HALF // 2 + y - a]
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (n, a, _), own in zip(where, tags_of, strict=True):
        if not own.any():
            continue
        kind = np.where(own == 0, -1, (own - 1) // 2)
        change = np.ones(len(own), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (own[1:] % 2 == 1) & (kind[1:] >= 0)
        begins = np.flatnonzero(change)
        for s, e in zip(begins.tolist(), [*begins[1:].tolist(), len(own)], strict=True):
            if kind[s] >= 0:
                found[n].append((KINDS[kind[s]], a + s, a + e))
    return found


def _whole(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span, grown to the ends of the words, or of the runs of digits, in which it begins and ends."""
    held = str.isdigit if kind != "email" else lambda c: c.isalnum() or c in "_-"
    if a < b and held(text[a]):
        while a and (held(text[a - 1]) or kind == "email" and text[a - 1] in ".%+"):
            a -= 1
    if a < b and held(text[b - 1]):
        while b < len(text) and held(text[b]):
            b += 1
    return a, b


def spans(network: Network, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, by a pattern), by kind and start."""
    out = []
    for text, more in zip(texts, network_spans(network, texts), strict=True):
        base = patterns(text)
        kept = [(*s, True) for s in base]
        for kind, a, b in more:
            while a < b and text[a].isspace():
                a += 1
            while a < b and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
                b -= 1
            a, b = _whole(kind, text, a, b)
            if kind != "email" or _plain_check(kind, text[a:b]):
                parts = [(a, b)]
            else:  # the network took in words beside the addresses
                parts = [m.span() for m in _WRITTEN.finditer(text, a, b)]
            for x, y in parts:
                # base spans stay; one that a wider span of its kind takes in whole, as letters beyond ASCII are no pattern's, doesn't rule that out
                if x < y and not any(x < q and p < y and not (k == kind and x <= p and q <= y and (x, y) != (p, q)) for k, p, q in base) and _plain_check(kind, text[x:y]):
                    kept.append((kind, x, y, False))
        out.append(sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _find(network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = spans(network.value, [t or "" for t in batch.column("text").to_pylist()])
            rows = [[{"kind": k, "start": a, "end": b, "base": c} for k, a, b, c in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPAN)], ["doc_id", "spans"])

    return run


def find(documents: DataFrame, seed: int = 7) -> DataFrame:
    """Per document: doc_id and spans, array of (kind, start, end, base), by kind and start."""
    spark = documents.sparkSession
    ship(spark)
    network = spark.sparkContext.broadcast(trained(spark, seed))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(network), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def report(documents: DataFrame, seed: int = 7) -> DataFrame:
    """Per document: doc_id, patterns' spans counted by kind, their digest, all spans, and how many the network added."""
    found = find(documents, seed)
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[_of_kind(k).alias(f"n_{k}") for k in KINDS], F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
