"""Personal data by patterns and a character-level bidirectional LSTM with CRF transitions (operator 9).

The patterns give the base spans. The network labels characters (none, email, ip, card, phone); it is trained in numpy, once for
each driver process, on ``TRAINING`` labelled texts that a seeded generator writes: prose with personal data in the usual forms and in
forms that the patterns miss (national phone numbers, dotted card numbers), and with numbers, dates, versions, keys and prices
that are none. Texts are read in overlapping windows; each window is decoded by Viterbi, every character takes the label of the
window in whose middle half it lies, and the labels of a whole text then become its spans. A span must hold a digit or
an at sign, so windows without either are labelled "none" unread: this is a constraint of the decoder, not a filter of rows.
A span of the network is added if it overlaps no base span and has its kind's form (at sign, four parts, Luhn digits, 8 to 15 digits).

Offsets are code points of the whole text. Null text: no spans. Repeated rows each come back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WINDOW, STRIDE = 96, 48
TRAINING = 3000
SIZE, DEPTH, CLASSES = 12, 8, 130
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def fits(kind: str, s: str) -> bool:
    """Whether a string has its kind's form beyond the pattern."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split(".")) if len(s) < 4000 else all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))
    digits = "".join(c for c in s if "0" <= c <= "9")
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that have its form; failing ones are dropped without another try."""
    found = []
    if "@" in text:
        # a match needs an at sign, and its first part can't begin before the run of its characters that ends there
        found += [("email", *m.span()) for m in _near_at(text)]
    if re.search("[0-9]", text):
        found += [(k, *m.span()) for k in KINDS[1:] for m in re.finditer(PATTERNS[k], text) if fits(k, m[0])]
    return found


def _near_at(text: str) -> Iterator[re.Match]:
    """The matches of the email pattern, looked for from the run of characters before each at sign only."""
    pattern, before, at = re.compile(PATTERNS["email"]), re.compile(r"[A-Za-z0-9._%+-]"), 0
    while True:
        i = text.find("@", at)
        if i < 0:
            return
        j = i
        while j > at and before.match(text[j - 1]):
            j -= 1
        m = pattern.match(text, j) if j < i else None
        if m:
            yield m
        at = m.end() if m else i + 1


def written(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled texts of the generator."""
    import random

    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters if r.random() < 0.97 else "éèüñçöóß") for _ in range(r.randint(1, 11)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        k = r.choice((16, 16, 16, 19))
        d = digits(k - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice(("", "", " ", "-", "."))[:1].join(d[i : i + 4] for i in range(0, k, 4)) if r.random() < 0.6 else d

    def email() -> str:
        name = r.choice((word(), f"{word()}.{word()}", f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}+{word()}"))
        host = r.choice((f"{word()}.{r.choice(('com', 'org', 'net', 'example', 'de'))}", f"mail{digits(1)}.example.{r.choice(('com', 'org'))}", f"{word()}.{word()}.co.uk"))
        return f"{name}@{host}".encode("ascii", "ignore").decode()

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+{digits(2)} {digits(3)} {digits(6)}", f"+{digits(11)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}"))

    address = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    none = (
        lambda: str(r.randint(0, 9999)),
        lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 30)}",
        lambda: f"{r.randint(0, 23):02}:{digits(2)}:{digits(2)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 18, 32, 40, 64)))),
        lambda: f"{r.randint(1, 999)},{digits(3)}.{digits(2)}",
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
        lambda: f"password={''.join(r.choice('0123456789abcdef') for _ in range(18))}",
        lambda: f"@{word()}",
        lambda: f"https://{word()}.com/{word()}/{digits(5)}",
        lambda: f"{word()}_{digits(3)}",
        lambda: digits(r.choice((*range(5, 15), *range(20, 40)))),
    )
    makers = {"email": email, "ip": address, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW + 20:
            kind = r.random()
            if kind < 0.12:
                k = r.choice(KINDS)
                s = makers[k]()
                spans.append((k, len(text), len(text) + len(s)))
                text += s
            elif kind < 0.22:
                text += r.choice(none)()
            else:
                w = word()
                text += w.capitalize() if r.random() < 0.15 else w
            text += r.choice((" ", " ", " ", " ", " ", ", ", ". ", ".\n"))
        out.append((text, spans))
    return out


def classes(points):
    """Class of each code point: ASCII its own, other letters one, the rest one."""
    import numpy as np

    return np.where(points < 128, points, np.where(points < 0x250, 128, 129)).astype(np.int16)


class Tagger:
    """Embedding, an LSTM in each direction, a linear layer, and CRF transitions."""

    def __init__(self, seed: int = 7):
        import numpy as np

        r = np.random.default_rng(seed)
        k = len(KINDS) + 1
        self.p = {"E": r.normal(0, 0.3, (CLASSES, DEPTH)), "Wo": r.normal(0, 0.2, (2 * SIZE, k)), "bo": np.zeros(k), "T": np.zeros((k, k))}
        for d in "fb":
            self.p |= {f"Wx{d}": r.normal(0, 0.3, (DEPTH, 4 * SIZE)), f"Wh{d}": r.normal(0, 0.2, (SIZE, 4 * SIZE)), f"b{d}": np.concatenate([np.zeros(SIZE), np.ones(SIZE), np.zeros(2 * SIZE)])}
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    @staticmethod
    def _gate(x):
        import numpy as np

        return 1 / (1 + np.exp(-x))

    def _run(self, x, d: str, tape: list | None = None):
        """Hidden states of one direction: x is (steps, texts)."""
        import numpy as np

        p = self.p
        table = p["E"] @ p[f"Wx{d}"] + p[f"b{d}"]
        h = c = np.zeros((x.shape[1], SIZE), np.float32)
        out = np.empty((len(x), x.shape[1], SIZE), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = table[x[t]] + h @ p[f"Wh{d}"]
            s = self._gate(z[:, : 3 * SIZE])
            g = np.tanh(z[:, 3 * SIZE :])
            i, f, o = s[:, :SIZE], s[:, SIZE : 2 * SIZE], s[:, 2 * SIZE :]
            before, c = c, f * c + i * g
            y = np.tanh(c)
            if tape is not None:
                tape.append((t, i, f, o, g, before, y, h))
            h = o * y
            out[t] = h
        return out

    def emissions(self, x, tapes: tuple | None = None):
        import numpy as np

        both = np.concatenate([self._run(x, d, tapes and tapes[k]) if tapes else self._run(x, d) for k, d in enumerate("fb")], 2)
        return both, both @ self.p["Wo"] + self.p["bo"]

    def decode(self, x):
        """Best labels (texts, steps) under emissions and transitions."""
        import numpy as np

        e = self.emissions(x.T)[1]
        score, back = e[0], []
        for t in range(1, len(e)):
            total = score[:, :, None] + self.p["T"]
            best = total.argmax(1)
            back.append(best)
            score = np.take_along_axis(total, best[:, None], 1)[:, 0] + e[t]
        at = score.argmax(1)
        out = [at]
        for best in reversed(back):
            at = best[np.arange(len(at)), at]
            out.append(at)
        return np.stack(out[::-1], 1).astype(np.int8)

    def step(self, x, y):
        """Gradients of the mean negative log-likelihood of labels y (texts, steps)."""
        import numpy as np

        p, x, y = self.p, x.T, y.T
        steps, n = x.shape
        tapes: tuple[list, list] = ([], [])
        both, e = self.emissions(x, tapes)
        k = e.shape[2]
        m = e.max(2, keepdims=True)
        w, tr = np.exp(e - m), np.exp(p["T"])
        a, b = np.empty_like(w), np.empty_like(w)
        a[0] = w[0] / w[0].sum(1, keepdims=True)
        for t in range(1, steps):
            v = (a[t - 1] @ tr) * w[t]
            a[t] = v / v.sum(1, keepdims=True)
        b[-1] = 1
        for t in range(steps - 2, -1, -1):
            v = (w[t + 1] * b[t + 1]) @ tr.T
            b[t] = v / v.sum(1, keepdims=True)
        gamma = a * b
        gamma /= gamma.sum(2, keepdims=True)
        one = np.eye(k, dtype=np.float32)[y]
        de = (gamma - one) / n
        pair = a[:-1, :, :, None] * tr * (w[1:] * b[1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        g = {"T": (pair.sum((0, 1)) - np.einsum("tni,tnj->ij", one[:-1], one[1:])) / n, "Wo": np.einsum("tnh,tnk->hk", both, de), "bo": de.sum((0, 1)), "E": np.zeros_like(p["E"])}
        dboth = de @ p["Wo"].T
        for q, d in enumerate("fb"):
            dh, dc = np.zeros((n, SIZE), np.float32), np.zeros((n, SIZE), np.float32)
            g[f"Wh{d}"] = np.zeros_like(p[f"Wh{d}"])
            table = np.zeros((CLASSES, 4 * SIZE), np.float32)
            for t, i, f, o, c, before, tanh_c, h in reversed(tapes[q]):
                dh = dh + dboth[t][:, q * SIZE : (q + 1) * SIZE]
                dc = dc + dh * o * (1 - tanh_c**2)
                dz = np.concatenate([dc * c * i * (1 - i), dc * before * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - c**2)], 1)
                g[f"Wh{d}"] += h.T @ dz
                np.add.at(table, x[t], dz)
                dh, dc = dz @ p[f"Wh{d}"].T, dc * f
            g[f"Wx{d}"], g[f"b{d}"] = p["E"].T @ table, table.sum(0)
            g["E"] += table @ p[f"Wx{d}"].T
        return g

    def train(self, texts, epochs: int = 4, batch: int = 32, rate: float = 0.03, seed: int = 3) -> Tagger:
        import numpy as np

        x = np.zeros((len(texts), WINDOW), np.int16)
        y = np.zeros((len(texts), WINDOW), np.int64)
        for k, (text, spans) in enumerate(texts):
            x[k] = classes(np.frombuffer(text.encode("utf-32-le"), "<u4"))[:WINDOW]
            for kind, a, b in spans:
                y[k, a:b] = KINDS.index(kind) + 1
        r = np.random.default_rng(seed)
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v = {n: np.zeros_like(w) for n, w in self.p.items()}
        k, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                k += 1
                for n, g in self.step(x[rows], y[rows]).items():
                    g = np.clip(g, -5, 5)
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.99 * v[n] + 0.01 * g * g
                    self.p[n] = (self.p[n] - rate * (1 - k / (steps + 1)) * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return self


_trained: dict[int, Tagger] = {}


def tagger(seed: int = 7) -> Tagger:
    """The trained network, once for each process."""
    if seed not in _trained:
        _trained[seed] = Tagger(seed).train(written(TRAINING, seed))
    return _trained[seed]


def labelled(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The network's spans of each text, over all overlapping windows that hold a digit or an at sign."""
    import numpy as np

    rows, owners, begins = [], [], []
    margin = (WINDOW - STRIDE) // 2
    for k, t in enumerate(texts):
        at = np.fromiter((m.start() for m in re.finditer("[0-9@]", t)), np.int64)
        if not len(at):
            continue
        codes = np.zeros(len(t) + 2 * WINDOW, np.int16)
        codes[margin : margin + len(t)] = classes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"))
        # window w reads [w * STRIDE - margin, ...) and answers for its middle, [w * STRIDE, (w + 1) * STRIDE)
        last = (len(t) - 1) // STRIDE
        own = np.unique(np.concatenate([np.clip((at + d) // STRIDE, 0, last) for d in (-margin, 0, margin)]))
        rows.append(codes[(own * STRIDE)[:, None] + np.arange(WINDOW)])
        owners.append(np.full(len(own), k))
        begins.append(own * STRIDE)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not rows:
        return out
    length = np.array([len(t) for t in texts])
    x, owner, begin = np.concatenate(rows), np.concatenate(owners), np.concatenate(begins)
    for part in range(0, len(x), 2048):
        label = model.decode(x[part : part + 2048])[:, margin : margin + STRIDE]
        w, c = np.nonzero(label)
        kind, text, place = label[w, c], owner[part + w], begin[part + w] + c
        real = place < length[text]
        kind, text, place = kind[real], text[real], place[real]
        if not len(kind):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(kind) != 0) | (np.diff(text) != 0)]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(kind)]):
            k, name, s, e = int(text[a]), KINDS[kind[a] - 1], int(place[a]), int(place[b - 1]) + 1
            if out[k] and out[k][-1][0] == name and out[k][-1][2] == s:  # the same span, cut by the end of a part
                s = out[k].pop()[1]
            out[k].append((name, s, e))
    return out


def added(kind: str, text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The network's span without surrounding marks, if it has its kind's form."""
    while end > start and text[end - 1] in " .,;:\n-(":
        end -= 1
    while end > start and text[start] in " .,;:\n-)":
        start += 1
    s = text[start:end]
    if kind == "email":
        good = re.fullmatch(PATTERNS["email"], s)
    elif kind == "ip":
        good = re.fullmatch(PATTERNS["ip"], s) and fits(kind, s)
    elif kind == "card":
        good = re.fullmatch(r"[0-9]([\x20./-]?[0-9])+", s) and fits(kind, s)
    else:
        good = re.fullmatch(r"\+?[(]?[0-9][\x20().0-9-]+[0-9]", s) and fits(kind, s) and re.search(r"[\x20().-]", s)
    whole = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
    return (kind, start, end) if good and whole else None


def spans_of(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    out = []
    for text, more in zip(texts, labelled(model, texts)):
        base = base_spans(text)
        spans = [(*s, True) for s in base]
        for s in more:
            s = added(s[0], text, s[1], s[2])
            if s and not any(s[1] < b[2] and b[1] < s[2] for b in base):
                spans.append((*s, False))
        out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


def find(df: DataFrame, text_col: str = "text", out_col: str = "personal", seed: int = 7) -> DataFrame:
    """``df`` with ``out_col``: an array of (kind, start, end, base), by kind, then start."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tagger(seed).p)
    at = df.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        model = Tagger(seed)
        model.p = shared.value
        for b in batches:
            found = spans_of(model, [x or "" for x in b.column(at).to_pylist()])
            rows = [[{"kind": k, "start": s, "end": e, "base": base} for k, s, e, base in f] for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, to_arrow_type(SPANS))], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, SPANS)]))
