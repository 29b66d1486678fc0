"""Plain Python versions of the operators, for small inputs."""
import collections
import hashlib
import math
import re
import zlib

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def cut_passages(docs, window):
    """{doc_id: (n_words, n_removed, kept)} of (doc_id, text) rows with distinct ids."""
    words = {d: SPACE.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i:i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone |= set(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def cut_lines(docs, threshold, least):
    """{doc_id: text that stays} of (doc_id, text) rows with distinct ids."""
    places = [(d, i, line) for d, t in sorted(docs) if t is not None for i, line in enumerate(t.split("\n"))]
    part = [p for p in places if len(p[2]) >= least]
    gone = {(d, i) for n, (d, i, line) in enumerate(part) for _, _, other in part[:n]
            if abs(len(line) - len(other)) <= threshold and (line == other or edit_distance(line, other) <= threshold)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def own_documents(docs, cut, least):
    """(doc_id, text) of the documents that stay: those that lost nothing, or have a long line left, or a short one that no
    earlier document has. ``docs`` are the rows before, ``cut`` the texts after lines were cut."""
    def filled(text):
        return [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    first = {}
    for d, text in sorted(docs):
        for line in filled(text or ""):
            first.setdefault(line, d)
    return [(d, cut[d]) for d, text in docs if cut[d] == text or any(
        len(x) >= least or first[x] == d for x in filled(cut[d]))]


def shingles(text, size):
    words = SPACE.findall(lower_ascii(text or ""))
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def near_components(docs, size, percent=80):
    """{doc_id: (set size, component)} of (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(t, size) for d, t in docs}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))


def hits(docs, items, window):
    """{doc_id: (n_words, hit positions, ids of items)} of rows with distinct ids."""
    wins = {}
    for item, text in items:
        w = item_words(text)
        if item is None:
            continue
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = {}
    for d, text in docs:
        w, hit, found = item_words(text), set(), set()
        for span in {len(x) for x in wins}:
            for i in range(len(w) - span + 1):
                own = wins.get(tuple(w[i:i + span]))
                if own:
                    hit |= set(range(i, i + span))
                    found |= own
        out[d] = (len(w), len(hit), sorted(found))
    return out


def language_model(rows, most):
    """Prediction (language, share) learnt from (doc_id, text, lang) rows: known words, else the longest known n-grams."""
    def words(text):
        return re.findall(r"[^\W\d_]+", (text or "").lower())

    def pieces(word, n):
        if n == 0:
            return [word]
        word = word if n == 1 else f" {word} "
        return [word[i:i + n] for i in range(len(word)) if len(word[i:i + n]) == n]

    counts = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))  # length -> language -> term
    for doc, text, lang in rows:
        if zlib.crc32(str(doc).encode()) % 4 != 2:
            for n in range(6):
                counts[n][lang].update(p for w in words(text) for p in pieces(w, n))
    languages = sorted(counts[0])
    for by_language in counts.values():
        for lang, terms in by_language.items():
            by_language[lang] = dict(sorted(terms.items(), key=lambda t: (-t[1], t[0].encode()))[:most])
    known = {n: set().union(*counts[n].values()) for n in counts}

    def frequency(n, term, lang):
        own = counts[n].get(lang, {})
        return math.log((own.get(term, 0) + 0.5) / (sum(own.values()) + 0.5 * (len(known[n]) + 1)))

    def word_score(word, lang):
        for n in (0, 5, 4, 3, 2, 1):
            found = [frequency(n, p, lang) for p in pieces(word, n) if p in known[n]]
            if found:
                return sum(found) / len(found)
        return 0.0

    def predict(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        scores = {lang: sum(word_score(w, lang) for w in words(text)) for lang in languages}
        best = max(languages, key=lambda lang: (round(scores[lang], 9), -languages.index(lang)))
        return best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())

    return predict
