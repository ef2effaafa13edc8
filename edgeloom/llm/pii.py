"""Personal data: rule spans, and spans of a character-level bidirectional LSTM with CRF transitions.

Rules give the base spans.  The model is trained in numpy on windows with labelled spans: base spans of a bounded sample of
documents, and the written templates below.  Each of the four kinds holds a digit or an '@', so only windows with
one can hold a span; a window without is all "outside" by the label set.  Windows overlap by half; each is decoded (Viterbi), and
one document's spans are reconciled as a whole: the set of non-overlapping spans with the largest total score.
Offsets are code points, ends exclusive.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import chunks, column_of, id_text, texts_of

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 400            # documents whose base spans are learned from
TRAIN_WINDOWS = 1500        # windows kept of them
WIDTH, STRIDE = 96, 48
MIN_GAIN = 4.0              # least log-score of a model span above "outside"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
# a match can only begin where a run of digits begins, hence the look-behind: linear on any text
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each '@' outwards, so a long run without one costs nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
            at = text.find("@", done)
        else:
            done = at + 1               # '@' is in no local part
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as listed, then start."""
    if not _TRIGGER.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 64:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- model
_N_SYMBOLS = 40
_SYMBOL = np.full(128, 3, np.int8)                       # 0 padding, 1 lower, 2 upper, 3 other, 4 digit, 5 white space
_SYMBOL[97:123], _SYMBOL[65:91], _SYMBOL[48:58] = 1, 2, 4
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 5
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _SYMBOL[ord(_c)] = 6 + _i
N_TAGS = 1 + 2 * len(KINDS)                              # 0 outside, 1+2k begin, 2+2k inside


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _SYMBOL[np.minimum(code, 127)], 1).astype(np.int8)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _lstm(x, wx, wh, b, keep=False):
    """Hidden states (T, N, H) over x (T, N, E); with ``keep`` also what the way back needs."""
    T, N, _ = x.shape
    H = wh.shape[0]
    h, c = np.zeros((N, H), np.float32), np.zeros((N, H), np.float32)
    pre = x @ wx + b
    out, saved = np.empty((T, N, H), np.float32), []
    for t in range(T):
        a = pre[t] + h @ wh
        s = _sigmoid(a[:, :3 * H])
        i, f, o, g = s[:, :H], s[:, H:2 * H], s[:, 2 * H:], np.tanh(a[:, 3 * H:])
        before, was = c, h
        c = f * c + i * g
        th = np.tanh(c)
        h = o * th
        out[t] = h
        if keep:
            saved.append((i, f, o, g, before, th, was))
    return (out, saved) if keep else out


def _lstm_back(dout, saved, x, wx, wh):
    T, N, H = dout.shape
    dx = np.empty_like(x)
    dwx, dwh, db = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * H, np.float32)
    dh, dc = np.zeros((N, H), np.float32), np.zeros((N, H), np.float32)
    for t in range(T - 1, -1, -1):
        i, f, o, g, before, th, was = saved[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - th * th)
        da = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)), 1)
        dwx += x[t].T @ da
        dwh += was.T @ da
        db += da.sum(0)
        dx[t] = da @ wx.T
        dh, dc = da @ wh.T, dc * f
    return dx, dwx, dwh, db


def _log_sum(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _new_model(seed=5, width=12, hidden=20):
    rng = np.random.default_rng(seed)

    def w(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    m = {"e": w(_N_SYMBOLS, width), "out": w(2 * hidden, N_TAGS), "bias": np.zeros(N_TAGS, np.float32),
         "move": np.zeros((N_TAGS, N_TAGS), np.float32)}
    for side in "lr":
        m |= {side + "x": w(width, 4 * hidden), side + "h": w(hidden, 4 * hidden), side + "b": np.zeros(4 * hidden, np.float32)}
        m[side + "b"][hidden:2 * hidden] = 1
    return m


def emissions(model: dict, x: np.ndarray) -> np.ndarray:
    """Tag scores (T, N, tags) of windows x (N, T)."""
    e = model["e"][x.T]
    left = _lstm(e, model["lx"], model["lh"], model["lb"])
    right = _lstm(e[::-1], model["rx"], model["rh"], model["rb"])[::-1]
    return np.concatenate((left, right), 2) @ model["out"] + model["bias"]


def _gradient(model, x, y):
    """Mean CRF loss of windows x with tags y (both (N, T)), and its gradient."""
    T, N = x.shape[1], x.shape[0]
    ids, y = x.T, y.T
    e = model["e"][ids]
    back = np.ascontiguousarray(e[::-1])
    left, sl = _lstm(e, model["lx"], model["lh"], model["lb"], True)
    right, sr = _lstm(back, model["rx"], model["rh"], model["rb"], True)
    both = np.concatenate((left, right[::-1]), 2)
    em = both @ model["out"] + model["bias"]
    move, rows = model["move"], np.arange(N)
    alpha, beta = np.empty((T, N, N_TAGS)), np.zeros((T, N, N_TAGS))
    alpha[0] = em[0]
    for t in range(1, T):
        alpha[t] = em[t] + _log_sum(alpha[t - 1][:, :, None] + move, 1)
    for t in range(T - 2, -1, -1):
        beta[t] = _log_sum(move + (em[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _log_sum(alpha[-1], 1)
    dem = np.exp(alpha + beta - z[:, None])
    dmove = np.zeros_like(move, dtype=float)
    for t in range(1, T):
        dmove += np.exp(alpha[t - 1][:, :, None] + move + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dmove, (y[t - 1], y[t]), -1.0)
    gold = sum(em[t, rows, y[t]] for t in range(T)) + sum(move[y[t - 1], y[t]] for t in range(1, T))
    for t in range(T):
        dem[t, rows, y[t]] -= 1
    dem = (dem / N).astype(np.float32)
    flat = both.reshape(-1, both.shape[2])
    g = {"out": flat.T @ dem.reshape(-1, N_TAGS), "bias": dem.sum((0, 1)), "move": (dmove / N).astype(np.float32)}
    dboth = dem @ model["out"].T
    H = left.shape[2]
    dx, g["lx"], g["lh"], g["lb"] = _lstm_back(dboth[:, :, :H], sl, e, model["lx"], model["lh"])
    dr, g["rx"], g["rh"], g["rb"] = _lstm_back(dboth[::-1, :, H:], sr, back, model["rx"], model["rh"])
    g["e"] = np.zeros_like(model["e"])
    np.add.at(g["e"], ids, dx + dr[::-1])
    return float((z - gold).mean()), g


def fit(x: np.ndarray, y: np.ndarray, *, epochs: int = 7, batch: int = 64, rate: float = 0.01, seed: int = 3) -> dict:
    """Adam on the CRF loss; the same windows give the same model."""
    model = _new_model()
    first, second, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            pick = order[i:i + batch]
            _, g = _gradient(model, x[pick], y[pick])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                now = rate * (0.3 if epoch > epochs // 2 else 1.0)
                model[k] -= now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
    return model


def _allowed() -> np.ndarray:
    """Inside k may only follow begin k or inside k."""
    no = np.zeros((N_TAGS, N_TAGS))
    for k in range(len(KINDS)):
        no[:, 2 + 2 * k] = -1e4
        no[1 + 2 * k, 2 + 2 * k] = no[2 + 2 * k, 2 + 2 * k] = 0
    return no


def decode(model: dict, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """Best path of each window as ``(kind number, start, end, score above "outside")`` spans."""
    out: list[list] = []
    move = model["move"] + _allowed()
    for i in range(0, len(x), 512):
        em = emissions(model, x[i:i + 512])
        T, N, _ = em.shape
        best, came = em[0].astype(float), np.empty((T, N, N_TAGS), np.int8)
        best[:, 2::2] -= 1e4
        for t in range(1, T):
            s = best[:, :, None] + move
            came[t] = s.argmax(1)
            best = s.max(1) + em[t]
        path = np.empty((T, N), np.int64)
        path[-1] = best.argmax(1)
        rows = np.arange(N)
        for t in range(T - 1, 0, -1):
            path[t - 1] = came[t, rows, path[t]]
        for n in range(N):
            spans, p = [], path[:, n]
            for a in np.flatnonzero(p % 2 == 1):
                b = a + 1
                while b < T and p[b] == p[a] + 1:
                    b += 1
                tags = p[a:b]
                gain = float((em[np.arange(a, b), n, tags] - em[np.arange(a, b), n, 0]).sum())
                spans.append((int(p[a]) // 2, int(a), int(b), gain))
            out.append(spans)
    return out


def window_starts(x: np.ndarray) -> np.ndarray:
    """Starts of the half-overlapping windows of a text that hold a digit or '@'."""
    hot = np.flatnonzero((x == 4) | (x == _SYMBOL[64]))
    k = hot // STRIDE
    return np.unique(np.concatenate((k, np.maximum(k - 1, 0)))) * STRIDE


def _cut(x: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WIDTH, np.int8)
    piece = x[start:start + WIDTH]
    out[:len(piece)] = piece
    return out


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of candidate spans of one document, the non-overlapping ones of the largest total score."""
    best: dict[tuple[int, int], tuple] = {}
    for s in found:
        if s[1:3] not in best or best[s[1:3]][3] < s[3]:
            best[s[1:3]] = s
    spans = sorted(best.values(), key=lambda s: (s[2], s[1]))
    ends = [s[2] for s in spans]
    total, take = [0.0], []
    for i, s in enumerate(spans):
        j = int(np.searchsorted(ends, s[1], "right"))
        j = min(j, i)
        take.append((total[j] + s[3] > total[i], j))
        total.append(max(total[i], total[j] + s[3]))
    out, i = [], len(spans)
    while i:
        if take[i - 1][0]:
            out.append(spans[i - 1])
            i = take[i - 1][1]
        else:
            i -= 1
    return out[::-1]


def find_spans(model: dict, texts: list[str]) -> list[tuple[list, list]]:
    """``(base spans, added spans)`` of each text."""
    base = [base_spans(t) for t in texts]
    windows, owner, xs = [], [], {}
    for i, t in enumerate(texts):
        if _TRIGGER.search(t):
            xs[i] = x = symbols(t)
            for s in window_starts(x):
                windows.append(_cut(x, s))
                owner.append((i, int(s)))
    found: dict[int, list] = {}
    for k in range(0, len(windows), 2048):
        for (i, s), spans in zip(owner[k:k + 2048], decode(model, np.array(windows[k:k + 2048]))):
            n = len(xs[i])
            for kind, a, b, gain in spans:
                inner = (a > 0 or s == 0) and (b < WIDTH or s + b >= n)         # else another window sees more of it
                b = min(b, n - s)
                if gain >= MIN_GAIN and a < b and (inner or b - a > STRIDE):
                    found.setdefault(i, []).append((kind, s + a, s + b, gain))
    out: list[tuple[list, list]] = [(b, []) for b in base]
    for i, cand in found.items():
        held = sorted((a, b) for _, a, b in base[i])
        starts = [a for a, _ in held]
        reach = np.maximum.accumulate([b for _, b in held]) if held else []
        for kind, a, b, _ in reconcile(cand):
            t = texts[i][a:b]
            a, b = a + len(t) - len(t.lstrip()), b - (len(t) - len(t.rstrip()))
            j = int(np.searchsorted(starts, b, "left"))
            digits = sum(c.isdigit() for c in texts[i][a:b])
            enough = "@" in texts[i][a + 1:b - 1] if kind == 0 else digits >= (4, 12, 7)[kind - 1]
            if a < b and enough and not (j and reach[j - 1] > a):
                out[i][1].append((KINDS[kind], a, b))
    return out


# ---------------------------------------------------------------- training rows
def _templates(rng: np.random.Generator, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Written examples ``(text, [(kind, start, end)])``: each kind in several forms, and look-alikes that are none."""
    def letters(a, b):
        return "".join(rng.choice(list("abcdefghijklmnoprstuvwyé"), int(rng.integers(a, b))))

    def digits(k):
        return "".join(rng.choice(list("0123456789"), k))

    def words(a, b):
        return " ".join(letters(1, 10) for _ in range(int(rng.integers(a, b))))

    def card():
        body = digits(15)
        last = next(str(c) for c in range(10) if _luhn(body + str(c)))
        d, sep = body + last, str(rng.choice(["", " ", "-", "."]))
        return sep.join(d[i:i + 4] for i in range(0, 16, 4))

    def phone():
        form = int(rng.integers(5))
        return (f"+1 ({digits(3)}) 555-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"({digits(3)}) {digits(3)}-{digits(4)}",
                f"+{digits(11)}", f"{digits(3)}-{digits(3)}-{digits(4)}")[form]

    def email():
        host = f"{letters(3, 8)}{digits(int(rng.integers(0, 2)))}.{rng.choice(['com', 'org', 'net', 'example.com', 'de'])}"
        return f"{letters(2, 9)}{rng.choice(['.', '_', '', '-'])}{digits(int(rng.integers(0, 3)))}@{host}"

    def ip():
        return ".".join(str(rng.integers(1, 256)) for _ in range(4))

    def none():
        form = int(rng.integers(8))
        return (f"password={digits(4)}ab{digits(3)}f{digits(6)}", "AKIA" + digits(3) + "QX" + digits(4) + "ZR", f"version {digits(1)}.{digits(1)}",
                f"BY-NC {digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"token = \"{digits(3)}e{digits(5)}c{digits(7)}a\"",
                digits(int(rng.integers(1, 7))), f"{digits(2)}:{digits(2)}, {digits(1)}.{digits(2)} %")[form]

    made = (email, ip, card, phone)
    out = []
    for i in range(n):
        before = words(0, 9)
        kind = i % 6
        text = made[kind]() if kind < 4 else none()
        lead = before + " " if before else ""
        out.append((lead + text + str(rng.choice([" ", ". ", ", ", "\n"])) + words(0, 8), [(kind, len(lead), len(lead) + len(text))] if kind < 4 else []))
    return out


def _labelled(text_x: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(len(text_x), np.int8)
    for kind, a, b in spans:
        if not y[a:b].any():
            y[a], y[a + 1:b] = 1 + 2 * kind, 2 + 2 * kind
    return y


def train(docs: DataFrame, *, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS, epochs: int = 7) -> dict:
    """A model from the base spans of at most ``train_docs`` documents (``train_windows`` windows) and 1,200 written examples.

    A table without any digit or '@' still gives a model, from the written examples alone.
    """
    ids = (id_text(docs).filter(F.col("text").rlike("[0-9@]")).select("doc_id").dropna()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))

    def examples(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = []
            for doc, t in zip(column_of(part, "doc_id").to_pylist(), texts_of(part)):
                x = symbols(t)
                y = _labelled(x, [(KINDS.index(k), a, b) for k, a, b in base_spans(t)])
                for s in window_starts(x)[:8]:           # a bound on one document's share of the training windows
                    if y[s] % 2 == 0 and y[s] or s + WIDTH < len(y) and y[s + WIDTH] % 2 == 0 and y[s + WIDTH]:
                        continue                         # a span cut by the edge teaches nothing
                    rows.append((doc, int(s), _cut(x, s).tobytes(), _cut(y, s).tobytes()))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                                              pa.array(cols[3], pa.binary())], ["doc_id", "start", "x", "y"])

    found = (id_text(docs).join(F.broadcast(ids), "doc_id")              # at most train_docs ids
             .mapInArrow(examples, "doc_id bigint, start bigint, x binary, y binary")
             .orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "x").limit(train_windows).toPandas())
    x = [np.frombuffer(b, np.int8) for b in found["x"]]
    y = [np.frombuffer(b, np.int8) for b in found["y"]]
    for text, spans in _templates(np.random.default_rng(11), 1200):
        s = symbols(text)[:WIDTH]
        x.append(_cut(s, 0))
        y.append(_cut(_labelled(s, [t for t in spans if t[2] <= len(s)]), 0))
    return fit(np.array(x), np.array(y), epochs=epochs)


def _join(spans) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def find(docs: DataFrame, model: dict) -> DataFrame:
    """One row a document: counts and digest of base spans, and all spans; null texts are empty, repeated rows repeat, no shuffle."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            both = find_spans(model, texts_of(part))
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [column_of(part, "doc_id"), *counts, pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b, _ in both], pa.string()),
                 pa.array([_join(b + a) for b, a in both], pa.string()), pa.array([len(a) for _, a in both], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
                                         "spans string, n_added bigint")


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch covered by spans becomes the mark of the kind that begins it, such as <EMAIL>."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: dict, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``; spans in the text are masked and, where there is one, the length column follows."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            at = part.schema.get_field_index(text_col)
            old = part.column(at).to_pylist()
            new = [None if t is None else mask_text(t, b + a) if b or a else t for t, (b, a) in zip(old, find_spans(model, [t or "" for t in old]))]
            columns = list(part.columns)
            columns[at] = pa.array(new, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema[length_col].dataType))
    return out
