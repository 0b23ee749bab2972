"""Plain Python versions of the operators' contracts, row by row."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def decontaminate(docs, items, width=13):
    phrases = defaultdict(set)
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            phrases[tuple(w[i : i + width])].add(item)
    lengths = {len(p) for p in phrases}
    out = {}
    for d, text in docs:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, named = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit.update(range(i, i + n))
                    named |= phrases[p]
        listed = ",".join(sorted(map(str, named)))
        out[d] = (len(w), len(hit), len(named), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def near_duplicates(docs, width, percent=80):
    sets = {}
    for d, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            s, t = sets[a], sets[b]
            if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, "hex", m.end()))
    found.sort()
    n = Counter(k for _, _, k, _ in found)
    listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(listed.encode()).hexdigest(), listed


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(runs)
    hit = {i + k for i, r in enumerate(runs) if counts[r] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def sentence_pieces(text, span=9, long=16):
    """Lists of words: sentences, long ones cut after the smallest word hash (the last of equals) of every span words."""
    import xxhash

    out = []
    for sentence in re.split(r"(?<=[.!?])[\x20\x09-\x0D]+|\n", text or ""):
        words = WORD.findall(sentence)
        if len(words) <= long:
            out += [words] if words else []
            continue
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
        cuts = set()
        for i in range(len(h) - span + 1):
            cuts.add(max(range(i, i + span), key=lambda k: (-h[k], k)))
        piece = []
        for i, w in enumerate(words):
            piece.append(w)
            if i in cuts or i == len(words) - 1:
                out.append(piece)
                piece = []
    return out


def sentence_spans(docs, least=16):
    """{doc: places of pieces that go}: those of every run (the shortest of enough words from a piece on) that occurred before."""
    seen, gone = set(), {}
    for d, text in sorted(docs):
        pieces, lost = sentence_pieces(text), set()
        for i in range(len(pieces)):
            n, j = 0, i
            while j < len(pieces) and n < least:
                n += len(pieces[j])
                j += 1
            if n < least:
                break
            run = tuple(w for p in pieces[i:j] for w in p)
            if run in seen:
                lost.update(range(i, j))
            seen.add(run)
        if lost:
            gone[d] = sorted(lost)
    return gone


def line_runs(docs, width=3, least=12):
    """[(places of deleted lines, text left)] of each (order, text): every repeated window that counts, by plain comparison."""
    seen, out = set(), []
    for _, text in docs:
        raw = (text or "").split("\n")
        at = [i for i, x in enumerate(raw) if x.strip(" \t\r\x0b\x0c")]
        lost = set()
        for p in range(len(at)):
            for size in range(1, width + 1):
                lines = tuple(raw[i] for i in at[p : p + size])
                if len(lines) < size or size < width and sum(len(WORD.findall(x)) for x in lines) < least:
                    continue
                if lines in seen:
                    lost.update(range(p, p + size))
                seen.add(lines)
        gone = {at[p] for p in lost}
        out.append((sorted(lost), text if not lost else "\n".join(x for i, x in enumerate(raw) if i not in gone)))
    return out


def tokens(docs, path, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    start, out = 0, {}
    for d, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out
