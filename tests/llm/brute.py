"""Plain, slow versions of the operators' contracts."""

import hashlib
import math
import re
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NONBLANK = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text)) if text is not None and item is not None else []
        k = min(13, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows[tuple(w[i : i + k])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = ALNUM.findall(low(text))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                own = windows.get(tuple(w[i : i + k]))
                if own:
                    hit.update(range(i, i + k))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def base_phrases(docs, phrases):
    out = []
    for doc, text in docs:
        w = ALNUM.findall(low(text))
        places = [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        out.append((doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    return out


def licences(docs, idf, base, templates, top_words=8, min_coverage=0.5):
    """(labels, score) by trying every template at every start."""
    own = [(label, ALNUM.findall(low(p)), ALNUM.findall(low(p)), True) for p, label in base.items()]
    own += [(label, ALNUM.findall(low(k)), ALNUM.findall(low(p)), False) for label, k, p in templates]
    out = []
    for _, text in docs:
        w = ALNUM.findall(low(text))
        present, labels, score = set(w), set(), 0.0
        for label, key, words, is_base in own:
            if not set(key) <= present:
                continue
            rare = sorted(set(words), key=lambda x: (-idf.get(x, 1.0), x))
            rare = set(rare if is_base else rare[:top_words])
            places = [q for q, x in enumerate(words) if x in rare]
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            for s in range(-len(words), len(w)):
                stands = [0 <= s + q < len(w) and w[s + q] == x for q, x in enumerate(words)]
                votes = sum(stands[q] for q in places)
                if not all(stands[at : at + len(key)]) or votes < (len(places) if is_base else max(min(2, len(places)), (len(places) + 1) // 2)):
                    continue
                cover = sum(idf.get(x, 1.0) for x, ok in zip(words, stands, strict=True) if ok) / sum(idf.get(x, 1.0) for x in words)
                if is_base or cover >= min_coverage:
                    labels.add(label)
                    score = max(score, cover)
        out.append((",".join(sorted(labels)), score))
    return out


def rules(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = NONBLANK.findall(text)
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if NONBLANK.search(line):
                dup += line in seen
                seen.add(line)
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    return out


def removed_words(docs):
    """The places of each document's words that go. Rows of one id are one document to the order of windows."""
    split = [(d, NONBLANK.findall(t or "")) for d, t in docs]
    first = {}
    last = float("inf")
    for d, w in split:
        for i in range(len(w) - 19):
            key, at = tuple(w[i : i + 20]), (last if d is None else d, i)
            first[key] = min(first.get(key, at), at)
    return [{j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (last if d is None else d, i) for j in range(i, i + 20)} for d, w in split]


def repeats(docs):
    out = []
    for (d, t), gone in zip(docs, removed_words(docs), strict=True):
        w = NONBLANK.findall(t or "")
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingle_sets(docs):
    own = []
    for _, text in docs:
        w = ALNUM.findall(low(text))
        own.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return own


def near(docs):
    """(class_id, text_id, n_copies, n_links, n_linked_texts) by position."""
    own = shingle_sets(docs)
    n = len(docs)
    linked = [{j for j in range(n) if j != i and own[i] and own[j] and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) - 1e-9} for i in range(n)]
    group = list(range(n))
    while True:
        new = [min([group[i], *(group[j] for j in linked[i])]) for i in range(n)]
        if new == group:
            break
        group = new

    def least(which):
        return min((docs[j][0] for j in which if docs[j][0] is not None), default=None)

    out = []
    for i in range(n):
        same = [j for j in range(n) if own[j] == own[i]] if own[i] else [i]
        out.append((least([j for j in range(n) if group[j] == group[i]]), least(same), len(same), len(linked[i]), len({own[j] for j in linked[i]} - {own[i]})))
    return out


def _letters(text):
    import unicodedata

    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in f"\n\n\n{text}\n".lower())
    return re.sub(" +", " ", kept)


def kneser_ney(taught, probe, order=4, discount=0.75):
    """Bits a character of the probe: interpolated Kneser-Ney by its definition."""
    count = [Counter() for _ in range(order + 1)]
    for t in taught:
        s = _letters(t)
        for i in range(1, len(s)):
            count[order][(" " * order + s[: i + 1])[-order:]] += 1
    for k in range(order - 1, 0, -1):  # in how many contexts a shorter gram ends
        count[k] = Counter(g[1:] for g in count[k + 1])
    uniform = 1 / (len(count[1]) + 1)

    def p(gram):
        if not gram:
            return uniform
        k = len(gram)
        own = {g: n for g, n in count[k].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return p(gram[1:])
        return max(own.get(gram, 0) - discount, 0) / total + discount * len(own) / total * p(gram[1:])

    s = _letters(probe)
    bits = [-math.log2(p((" " * order + s[: i + 1])[-order:])) for i in range(1, len(s))]
    return sum(bits) / max(1, len(bits))
