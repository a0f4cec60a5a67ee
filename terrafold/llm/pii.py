"""Personal information in free text: found by a linear-chain conditional random field over word shapes, replaced by typed placeholders.

The model is trained from the labelled table in `labelled` (a few thousand short texts, the bound is LABELLED_ROWS) when
first needed, a few seconds on the driver, and sent to the workers once; its size is fixed by BUCKETS. Texts are
decoded whole, in batches, however long they are. Features are numbers computed for whole batches in numpy: the word,
its shape, affixes, the neighbours, and for numbers the shape of the whole run of digits and the words around the run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import crf, labelled
from terrafold.session import spread_out

BUCKETS = 1 << 18
LABELLED_ROWS = 7000
LABELS = ["O", *[f"{p}-{k}" for k in labelled.KINDS for p in "BI"]]
#: Tokens decoded at once, by five characters a token; a longer text is decoded in pieces that see CONTEXT characters more on either side.
MAX_TOKENS, CONTEXT = 150_000, 4_000

#: Signs by which an e-mail address is recognised, and what may follow: written out or spaced.
_AT = re.compile(r"@|[(\[]at[)\]]|(?<=\s)at(?=\s)", re.I)
_DOMAIN = re.compile(r"[^\S\n]*[\w-]+(?:[^\S\n]*(?:\.|\(dot\)|\[dot\])[^\S\n]*[\w-]+|[^\S\n]+dot[^\S\n]+[\w-]+)+", re.I)
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_ZERO_WIDTH = "\u200b"


def _tables() -> tuple[np.ndarray, ...]:
    """Of each character of the basic plane: its class, its lower case (digits become 0), its shape (X, x, d or itself), whether it joins digits."""
    kind, lower, shape, joins = np.full(65536, _OTHER, np.uint8), np.arange(65536, dtype=np.uint32), np.arange(65536, dtype=np.uint32), np.zeros(65536, bool)
    for k in range(65536):
        c = chr(k)
        if c.isspace():
            kind[k] = _SPACE
        elif c.isdecimal():
            kind[k], lower[k], shape[k] = _DIGIT, ord("0"), ord("d")
        elif c.isalnum():
            kind[k] = _LETTER
            low = c.lower()
            if len(low) == 1:
                lower[k] = ord(low)
            shape[k] = ord("X") if c.isupper() else ord("x") if c.islower() else k
        joins[k] = c in " \u00a0().-/+"
    return kind, lower, shape, joins


_table: tuple[np.ndarray, ...] | None = None


def _mix(*cols) -> np.ndarray:
    h = np.zeros(len(cols[0]), np.uint32)
    for c in cols:
        h ^= c.astype(np.uint32, copy=False)
        h *= np.uint32(0x5BD1E995)
        h ^= h >> np.uint32(15)
    return h


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint32(1), np.full(max(n, 1), 0x01000193, np.uint32)], dtype=np.uint32)


def _paint(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the spans [i, j), and which span each is of."""
    ln = j - i
    span = np.repeat(np.arange(len(i)), ln)
    return np.arange(ln.sum()) + (i - np.r_[0, np.cumsum(ln)[:-1]])[span] if len(i) else np.zeros(0, np.int64), span


def _addresses(text: str) -> list[tuple[int, int]]:
    """Spans that look like e-mail addresses, written out or spaced ones included."""
    out = []
    flat = text.replace(_ZERO_WIDTH, " ") if _ZERO_WIDTH in text else text
    for m in _AT.finditer(flat):
        d = _DOMAIN.match(flat, m.end())
        if d is None:
            continue
        j = m.start()
        while j and flat[j - 1] != "\n" and flat[j - 1].isspace():
            j -= 1
        k = j
        while k and not flat[k - 1].isspace():
            k -= 1
        if k < j:
            out.append((k, d.end()))
    return out


def features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(bucket numbers, an array for each feature type; begins and ends within the text; tokens of each text).

    Tokens are runs of letters (apostrophes between letters included), runs of digits, and single other characters. The
    texts are read as one array of code points, joined by line ends, which no token or pattern crosses; words, affixes
    and shapes enter by polynomial hashes over that array, so no Python object is made for a token.
    """
    global _table
    if _table is None:
        _table = _tables()
    kind_t, lower_t, shape_t, joins_t = _table
    whole = "\n".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.r_[0, np.cumsum(size + 1)[:-1]]
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = cp > 65535
    small = np.where(far, 0, cp)
    kind = np.where(far, _OTHER, kind_t[small]).astype(np.uint8)
    if len(cp) > 2:
        tick = np.nonzero((cp == 39) | (cp == 0x2019))[0]
        tick = tick[(tick > 0) & (tick < len(cp) - 1)]
        kind[tick[(kind[tick - 1] == _LETTER) & (kind[tick + 1] == _LETTER)]] = _LETTER
    solid = kind != _SPACE
    starts = solid & ((kind == _OTHER) | np.r_[True, kind[1:] != kind[:-1]])
    ends = solid & ((kind == _OTHER) | np.r_[kind[1:] != kind[:-1], True])
    begin, end = np.nonzero(starts)[0], np.nonzero(ends)[0] + 1
    n = len(begin)
    if not n:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    owner = np.searchsorted(offset, begin, "right") - 1
    lengths = np.bincount(owner, minlength=len(texts))
    start = np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    stop = start + np.repeat(lengths, lengths)
    # Hashes of each token from its characters.
    at_char = np.nonzero(solid)[0]
    token = np.cumsum(starts)[at_char] - 1
    first_char = np.searchsorted(at_char, begin)
    pos, rest = at_char - begin[token], end[token] - 1 - at_char
    width = end - begin
    power = _powers(int(width.max()))
    low_c, shape_c = np.where(far, cp, lower_t[small])[at_char], np.where(far, cp, shape_t[small])[at_char]

    def poly(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, first_char, dtype=np.uint32)

    forward = low_c * power[pos]
    backward = low_c * power[np.minimum(rest, 3)]
    zero = np.uint32(0)
    low = poly(forward) + width.astype(np.uint32) * np.uint32(0x9E3779B1)
    pre, suf, suf2 = poly(np.where(pos < 3, forward, zero)), poly(np.where(rest < 3, backward, zero)), poly(np.where(rest < 2, backward, zero))
    again = (pos > 1) & ((shape_c == 88) | (shape_c == 120))
    again[2:] &= (shape_c[2:] == shape_c[1:-1]) & (shape_c[2:] == shape_c[:-2])
    kept = np.cumsum(~again) - 1
    shape = poly(np.where(again, zero, shape_c * power[kept - kept[first_char][token]])) * np.uint32(0x85EBCA6B)
    size_ = np.minimum(width, 12).astype(np.uint32)
    here = np.arange(n)
    last_end = np.r_[0, end[:-1]]
    line = np.cumsum(cp == 10)
    broken = line[np.maximum(begin - 1, 0)] > np.where(last_end > 0, line[last_end - 1], 0)
    space = np.where(here == start, 1, np.where(broken, 2, np.where(begin > last_end, 1, 0))).astype(np.uint32)
    inside = {k: (here + k >= start) & (here + k < stop) for k in (-3, -2, -1, 1, 2, 3)}

    def at(col: np.ndarray, k: int) -> np.ndarray:
        out = np.full(n, 7, np.uint32)
        if abs(k) < n:
            if k > 0:
                out[:-k] = col[k:]
            else:
                out[-k:] = col[:k]
        out[~inside[k]] = 7
        return out

    def pick(col: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.where((where >= start) & (where < stop), col[np.clip(where, 0, n - 1)], np.uint32(7))

    # Runs of digits, joined by up to three blanks, dots and the like, with a plus or bracket before: shape, first and last token.
    run, first, last = np.zeros(n, np.uint32), here.copy(), here.copy()
    d = np.nonzero(kind[begin] == _DIGIT)[0]
    if len(d):
        odd = np.cumsum(np.where(far, True, ~joins_t[small]))
        joined = (begin[d[1:]] - end[d[:-1]] <= 3) & (odd[begin[d[1:]] - 1] == odd[end[d[:-1]] - 1])
        i, j = d[np.r_[True, ~joined]], d[np.r_[~joined, True]] + 1
        lead = np.maximum(i - 1, 0)
        i = np.where((i > 0) & (end[lead] == begin[i]) & np.isin(cp[begin[lead]], (40, 43)), lead, i)
        chars, span = _paint(begin[i], end[j - 1])
        c = np.where(far, cp, lower_t[small])[chars]
        value = np.where(c == 0xA0, np.uint32(32), c) * _powers(int((end[j - 1] - begin[i]).max()))[chars - begin[i][span]]
        ids = np.add.reduceat(value, np.searchsorted(span, np.arange(len(i))), dtype=np.uint32) | np.uint32(1)
        where, span = _paint(i, j)
        run[where], first[where], last[where] = ids[span], i[span], j[span] - 1
    mail = np.zeros(n, np.uint32)
    found = _addresses(whole)
    if found:
        i, j = (np.searchsorted(begin, [f[k] for f in found]) for k in (0, 1))
        mail[_paint(i, j)[0]] = 1
        mail[i] = 2
    before = {k: at(low, -k) for k in (1, 2, 3)}
    after = {k: at(low, k) for k in (1, 2, 3)}
    sh_b, sh_a, sh_b2, sh_a2 = at(shape, -1), at(shape, 1), at(shape, -2), at(shape, 2)
    space_a = at(space, 1)
    leads, numeric = (here == first).astype(np.uint32), run > 0
    three = np.uint32(3)
    run_b, run_b2 = np.where(numeric, pick(low, first - 1), three), np.where(numeric, pick(low, first - 2), three)
    run_a, run_a2 = np.where(numeric, pick(low, last + 1), three), np.where(numeric, pick(low, last + 2), three)
    cols = [
        _mix(low), _mix(shape), _mix(pre), _mix(suf), _mix(suf2), _mix(shape, size_), _mix(shape, space, space_a), _mix(shape, suf),
        _mix(before[1]), _mix(before[2]), _mix(before[3]), _mix(after[1]), _mix(after[2]), _mix(after[3]),
        _mix(before[1], shape), _mix(after[1], shape), _mix(before[2], before[1], shape), _mix(after[1], after[2], shape), _mix(sh_b, shape, sh_a),
        _mix(sh_b2, sh_b, shape), _mix(shape, sh_a, sh_a2), _mix(at(suf, -1), shape), _mix(at(suf, 1), shape),
        _mix(run, leads), _mix(run, pick(low, first - 1)), _mix(run_b, run_b2, leads), _mix(run_a, run), _mix(run_a, run_a2, numeric),
        _mix(mail, shape), _mix(at(mail, -1), mail, at(mail, 1)), _mix(space, before[1], low), _mix(low, after[1], space_a),
    ]
    for k, c in enumerate(cols):
        c += np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
        c ^= c >> np.uint32(13)
        c &= np.uint32(BUCKETS - 1)
    return cols, begin - offset[owner], end - offset[owner], lengths


def gold_labels(mentions: list[tuple[str, int, int]], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    y = np.zeros(len(begin), np.int64)
    for kind, b, e in mentions:
        inside = (begin >= b) & (end <= e)
        idx = np.nonzero(inside)[0]
        y[idx] = LABELS.index("I-" + kind)
        y[idx[:1]] = LABELS.index("B-" + kind)
    return y


_model: dict[tuple, crf.Model] = {}


def model(rows: int = LABELLED_ROWS, seed: int = 11) -> crf.Model:
    """The trained model, once a process."""
    if (rows, seed) not in _model:
        table = labelled.table(rows, seed)
        f, b, e, ln = features([t for t, _ in table])
        cut = np.cumsum(ln)[:-1]
        y = np.concatenate([gold_labels(m, bb, ee) for (_, m), bb, ee in zip(table, np.split(b, cut), np.split(e, cut))])
        _model[(rows, seed)] = crf.train(np.stack(f, 1), y, ln, LABELS, BUCKETS)
    return _model[(rows, seed)]


_ABBREVIATED = re.compile(r"(?:\b(?:st|rd|ave|blvd|ln|dr|ct)|str)$", re.I)


def _tidy(text: str, kind: str, b: int, e: int) -> tuple[int, int] | None:
    """Exact bounds of a decoded mention; None where it cannot be one of its kind."""
    while b < e and (text[b].isspace() or text[b] in ",;:<​"):
        b += 1
    while e > b and (text[e - 1].isspace() or text[e - 1] in ",;:>​"):
        e -= 1
    # A name ends with its line, an address at the latest before an empty one.
    gap = re.search(r"[\r\n]" if kind == "name" else r"\n\s*\n", text[b:e]) if kind in ("name", "address") else None
    if gap:
        e = b + gap.start()
        while e > b and (text[e - 1].isspace() or text[e - 1] in ",;:"):
            e -= 1
    m = text[b:e]
    digits = sum(c.isdigit() for c in m)
    if kind == "phone":
        k = re.search(r"[+(\d]", m)
        if not k or digits < 7:
            return None
        b += k.start()
        while e > b and not text[e - 1].isdigit():
            e -= 1
    elif kind == "idno":
        if digits < 5:
            return None
        while e > b and not text[e - 1].isalnum():
            e -= 1
        while b < e and not text[b].isalnum():
            b += 1
    elif kind == "email":
        if not re.search(r"@|\bat\b", m, re.I):
            return None
        while e > b and not text[e - 1].isalnum():
            e -= 1
    elif kind == "name":
        while e > b and not text[e - 1].isalnum():
            e -= 1
        if e - b < 2 or digits:
            return None
    elif kind == "address":
        if not digits:
            return None
        while e > b and not (text[e - 1].isalnum() or (text[e - 1] == "." and _ABBREVIATED.search(text[b : e - 1]))):
            e -= 1
        if text[e - 1] == "." and _ends_sentence(text, e):
            e -= 1
        elif text[e : e + 1] == "." and _ABBREVIATED.search(text[b:e]) and not _ends_sentence(text, e + 1):
            e += 1
    return (b, e) if e > b else None


def _ends_sentence(text: str, e: int) -> bool:
    """Whether the dot before e ends a sentence: nothing, a line end or a capital or digit follows."""
    rest = text[e:]
    k = re.match(r"[  ]*", rest).end()
    return not (rest[k : k + 1].islower() or rest[:1] in ".,;")


def decode(texts: list[str], m: crf.Model) -> list[list[tuple[str, int, int]]]:
    """Mentions (kind, begin, end) of each text, in order, not overlapping."""
    f, b, e, ln = features(texts)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not len(b):
        return out
    emis = np.zeros((len(b), len(LABELS)), np.float32)
    for c in f:
        emis += m.weights[c]
    y = crf.viterbi(m, emis, ln)
    owner = np.repeat(np.arange(len(texts)), ln)
    kind = (y + 1) // 2  # 0 outside, then one number a kind
    # A mention starts at B, or at an I that follows another kind or another text.
    opens = (y > 0) & ((y % 2 == 1) | np.r_[True, (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])])
    starts = np.nonzero(opens)[0]
    group = np.cumsum(opens)
    for s in starts:
        t = s
        while t + 1 < len(y) and kind[t + 1] == kind[s] and group[t + 1] == group[s] and owner[t + 1] == owner[s]:
            t += 1
        k = owner[s]
        fit = _tidy(texts[k], labelled.KINDS[kind[s] - 1], int(b[s]), int(e[t]))
        if fit and not (out[k] and fit[0] < out[k][-1][2]):
            out[k].append((labelled.KINDS[kind[s] - 1], *fit))
    return out


def _blocks(texts: list[str]) -> Iterator[slice]:
    """Slices of about MAX_TOKENS tokens; a longer text is a block of its own."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) // 5 > MAX_TOKENS:
            yield slice(at, k)
            at, size = k, 0
        size += len(t) // 5
    if at < len(texts):
        yield slice(at, len(texts))


def _cuts(text: str) -> list[int]:
    """Where a long text is cut: every MAX_TOKENS tokens at the last empty line, else line end, else blank, of the piece's second half."""
    cuts, step = [0], MAX_TOKENS * 5
    while len(text) - cuts[-1] > step:
        a, b = cuts[-1] + step // 2, cuts[-1] + step
        at = next((k + len(sign) for sign in ("\n\n", "\n", " ") if (k := text.rfind(sign, a, b)) >= 0), b)
        cuts.append(at)
    return [*cuts, len(text)]


def find(texts: list[str], m: crf.Model) -> Iterator[list[tuple[str, int, int]]]:
    """`decode` for any texts, in blocks of bounded size. What begins in a piece of a long text is found there, with the context of its neighbours."""
    for s in _blocks(texts):
        block = texts[s]
        if len(block) > 1 or len(block[0]) <= MAX_TOKENS * 5:
            yield from decode(block, m)
            continue
        text, out = block[0], []
        cuts = _cuts(text)
        for a, b in zip(cuts, cuts[1:]):
            lo = max(0, a - CONTEXT)
            for kind, x, y in decode([text[lo : b + CONTEXT]], m)[0]:
                if a <= x + lo < b and not (out and x + lo < out[-1][2]):
                    out.append((kind, x + lo, y + lo))
        yield out


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")


def mentions(documents: DataFrame) -> DataFrame:
    """doc_id, kind, begin_at, end_at of each mention, in code points. Null and empty texts have none; equal rows give equal mentions once."""
    sent = documents.sparkSession.sparkContext.broadcast(model())  # BUCKETS x labels numbers, a fixed size

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *x) for i, found in zip(b.doc_id.tolist(), find(b.text.tolist(), sent.value)) for x in found]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "kind", "begin_at", "end_at"])

    return spread_out(_texts(documents)).mapInPandas(each, "doc_id long, kind string, begin_at int, end_at int").distinct()


def redacted(documents: DataFrame) -> DataFrame:
    """doc_id, text with each mention replaced by its kind in square brackets, n_mentions; null and empty texts stay as they are."""
    sent = documents.sparkSession.sparkContext.broadcast(model())

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            if not len(b):
                continue
            texts = [t if isinstance(t, str) else "" for t in b.text]
            new, count = [], []
            for t, found in zip(texts, find(texts, m)):
                parts, at = [], 0
                for kind, x, y in found:
                    parts += [t[at:x], f"[{kind.upper()}]"]
                    at = y
                new.append("".join([*parts, t[at:]]))
                count.append(len(found))
            out = b[["doc_id"]].copy()
            out["text"] = [None if not isinstance(o, str) else n for o, n in zip(b.text, new)]
            out["n_mentions"] = np.array(count, np.int32)
            yield out

    return spread_out(documents.select("doc_id", "text")).mapInPandas(replace, "doc_id long, text string, n_mentions int")
