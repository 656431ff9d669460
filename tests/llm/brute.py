"""Plain versions of what the operators compute, for small inputs."""

import collections
import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeated(words, size):
    grams = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
    counts = collections.Counter(grams)
    marks = [False] * len(words)
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            marks[i:i + size] = [True] * size
    return marks


def rules(text, config):
    words = SPACE_WORD.findall(text or "")
    chars = sum(map(len, words))
    seen, copies, copied = set(), 0, 0
    for line in (text or "").split("\n"):
        own = SPACE_WORD.findall(line)
        if own:
            if line in seen:
                copies += 1
                copied += sum(map(len, own))
            seen.add(line)
    n_repeat = sum(repeated(words, config.repeat_size))
    base = len(words) < config.least_words or 100 * n_repeat > config.repeat_percent * len(words)
    covered = copied > config.line_coverage * chars or any(
        sum(len(w) for w, m in zip(words, repeated(words, n)) if m) > share * chars for n, share in config.coverage
    )
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), chars, symbols, copies, n_repeat, base, not base and not covered


def shingles(text, size=5):
    words = SPACE_WORD.findall(lower(text))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(texts, percent=85):
    """Smallest reachable id by id, of {id: text}."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    low, high = sorted((find(a), find(b)))
                    parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def windows(benchmark, size=10):
    out = collections.defaultdict(set)
    for item, text in benchmark:
        words = LETTER_WORD.findall(lower(text))
        for k in range(max(1, len(words) - size + 1)) if words else ():
            out[tuple(words[k:k + size])].add(item)
    return out


def contamination(text, found):
    words, hit, items = LETTER_WORD.findall(lower(text)), set(), set()
    for size in {len(k) for k in found}:
        for k in range(len(words) - size + 1):
            own = found.get(tuple(words[k:k + size]))
            if own is not None:
                hit.update(range(k, k + size))
                items |= own
    names = sorted(str(i) for i in items if i is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Target by source of {source: words}; None is the last source."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > cap * sizes[s]]
        if not over:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= set(over)
    return out
