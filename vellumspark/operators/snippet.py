"""The passage that is shown of a hit: which window of tokens, and what is marked in it.

Windows are judged by the phrases that start in them: the first start of a phrase weighs a
thousand, each further one weighs one. Candidates are the windows that begin at a phrase (shown
with their phrases in the middle) and, in texts longer than a window, those that begin at the sentence
around a phrase, which have a bonus. Of equals the first in reading order wins. Runs on the top rows of
a search only, in the order and with the ties of SQLite's FTS5.
"""

from bisect import bisect_left, bisect_right

from vellumspark.operators.query_language import Phrase, Query, token_spans

# Weights of a phrase's first and further starts, bonus of a sentence and of the text's first one,
# and the signs that end a sentence before white space.
FIRST, AGAIN, SENTENCE, BEGINNING = 1000, 1, 100, 120
ENDS, WHITE = ".:", " \t\n\r"


def starts_in(words: list[str], phrase: Phrase) -> list[int]:
    """Places at which a phrase starts among the tokens of a column."""
    n = len(phrase.tokens)
    if not n:
        return []
    head, last = phrase.tokens[:-1], phrase.tokens[-1]
    fits = (lambda w: w.startswith(last)) if phrase.prefix else (lambda w: w == last)
    places = range(0, min(1, len(words) - n + 1)) if phrase.first else range(len(words) - n + 1)
    return [i for i in places if fits(words[i + n - 1]) and words[i : i + n - 1] == head]


def near_places(found: list[list[int]], sizes: list[int], distance: int) -> list[list[int]]:
    """Of each phrase's starts in one column, those that share a stretch with starts of all the others:
    counted back from its last start, the stretch has room for a phrase and ``distance`` tokens."""
    out = [set() for _ in found]
    for end in sorted({s for f in found for s in f}):
        here = [f[bisect_left(f, end - n - distance) : bisect_right(f, end)] for f, n in zip(found, sizes)]
        if all(here):
            for kept, places in zip(out, here):
                kept.update(places)
    return [sorted(s) for s in out]


def marks(query: Query, columns: dict[str, list[str]], shown: str) -> list[tuple[int, int]]:
    """(start, phrase) of what matched in the column ``shown``, in reading order: phrases of parts of the
    query that hold for the whole row."""
    found = {c: [starts_in(words, p) if p.columns is None or c in p.columns else [] for p in query.phrases] for c, words in columns.items()}

    def holds(tree: tuple) -> dict[int, list[int]] | None:
        """Starts by phrase in the shown column, or None if the part doesn't match."""
        kind = tree[0]
        if kind == "group":
            return holds(tree[1])
        if kind == "phrase":
            return {tree[1]: found[shown][tree[1]]} if any(f[tree[1]] for f in found.values()) else None
        if kind == "near":
            sizes = [len(query.phrases[k].tokens) for k in tree[1]]
            close = {c: near_places([f[k] for k in tree[1]], sizes, tree[2]) for c, f in found.items()}
            return dict(zip(tree[1], close[shown])) if any(all(c) for c in close.values()) else None
        left, right = holds(tree[1]), holds(tree[2])
        if kind == "or":
            return None if left is None and right is None else (left or {}) | (right or {})
        if kind == "not":
            return left if right is None else None
        return None if left is None or right is None else left | right

    return sorted((s, k) for k, places in (holds(query.tree) or {}).items() for s in places)


def sentence_starts(text: str, spans: list[tuple]) -> list[int]:
    out = [0] if spans else []
    for k, (a, *_) in enumerate(spans[1:], 1):
        gap = text[spans[k - 1][1] : a]
        bare = gap.rstrip(WHITE)
        if bare != gap and bare[-1:] in ENDS and bare:
            out.append(k)
    return out


def best_window(found: list[tuple[int, int]], sizes: list[int], sentences: list[int], n: int, width: int) -> int:
    """The first token of the best window over ``n`` tokens."""
    at = [s for s, _ in found]

    def judged(start: int) -> tuple[int, list]:
        inside = found[bisect_left(at, start) : bisect_left(at, start + width)]
        different = len({k for _, k in inside})
        return FIRST * different + AGAIN * (len(inside) - different), inside

    best, begin = 0, 0
    for start, _ in found:
        score, inside = judged(start)
        if score > best:
            room = width - (inside[-1][0] + sizes[inside[-1][1]] - inside[0][0])
            middle = inside[0][0] - (room // 2 if room >= 0 else -(-room // 2))
            best, begin = score, max(0, min(middle, n - width))
        sentence = sentences[bisect_right(sentences, start) - 1]
        if n > width and sentence < start:
            score = judged(sentence)[0] + (SENTENCE if sentence else BEGINNING)
            if score > best:
                best, begin = score, sentence
    return begin


def runs(found: list[tuple[int, int]], sizes: list[int], begin: int) -> list[list[int]]:
    """First and last token of what is marked together: starts within a marked run make it longer. Runs that begin before the window are not marked."""
    out = []
    for start, k in found:
        last = start + sizes[k] - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([start, last])
    return [r for r in out if r[0] >= begin]


def snippet(query: Query, texts: dict[str, str], shown: str, width: int, signs: tuple[str, str, str]) -> str:
    """The window of the text ``shown`` with its phrases marked; signs: before and after a mark, and for text left out."""
    spans = {c: token_spans(t) for c, t in texts.items()}
    text, own = texts[shown], spans[shown]
    if not own:
        return text
    sizes = [len(p.tokens) for p in query.phrases]
    found = marks(query, {c: [w for _, _, w in s] for c, s in spans.items()}, shown)
    begin = best_window(found, sizes, sentence_starts(text, own), len(own), width)
    end = min(begin + width, len(own))
    pieces, at = [signs[2]] if begin else [], own[begin][0] if begin else 0
    for first, last in runs(found, sizes, begin):
        if first >= end:
            break
        a, b = own[first][0], own[min(last, end - 1)][1]
        pieces += [text[at:a], signs[0], text[a:b], signs[1]]
        at = b
    pieces += [text[at:]] if begin + width >= len(own) else [text[at : own[end - 1][1]], signs[2]]
    return "".join(pieces)
