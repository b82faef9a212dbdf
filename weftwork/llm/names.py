"""Readings of a business name: what is left of it without legal form, additions, decoration and alias.

A reading is a key (the words of the name proper, joined), the trade word (or none) and the words. Typed names have several: either
side of an alias, the words in another order, with a word read as a shortened trade word or not.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from weftwork.llm.addresses import fold

LEGAL = frozenset("inc incorporated llc llp lp co company corp corporation ltd limited private pvt plc sarl sas sasu sa sci eurl snc gmbh liability p".split())
LEGAL_LONG = tuple(w for w in LEGAL if len(w) >= 6)
GENERAL = frozenset("services service group groupe center centre holding holdings ventures the and et".split())
ALIAS = re.compile(r"[\s,(]+(?:f\s*[/.]?\s*k\s*[/.]?\s*a|a\s*[/.]?\s*k\s*[/.]?\s*a|d\s*[/.]?\s*b\s*[/.]?\s*a|formerly|trading as|also known as|doing business as)\b[\s.:]+")
DOMAIN = re.compile(r"(?:https?://)?(?:www\.)?([a-z0-9-]{3,})\.(?:com|in|fr|org|net|co|biz|us|info)\b/?$")
HANDLE = re.compile(r"[@#]\s*([a-z0-9_-]{3,})$")
#: Short forms of given names by their full form.
NICK = {
    "alexander": "alex sandy xander", "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb", "benjamin": "ben", "catherine": "cathy kate",
    "charles": "charlie chas chuck", "christopher": "chris", "daniel": "dan danny", "deborah": "deb debbie debra", "edward": "ed eddie ned ted", "elizabeth": "liz beth betty eliza lizzie",
    "frederick": "fred freddy freddie", "james": "jim jimmy", "jennifer": "jen jenny", "john": "jack johnny", "joseph": "joe", "katherine": "kate kathy katie kath", "margaret": "maggie meg peggy marge",
    "michael": "mike mick mickey", "nicholas": "nick", "patricia": "pat patty trish tricia", "richard": "rick dick rich ricky", "robert": "bob rob bobby robt", "samuel": "sam", "stephen": "steve",
    "susan": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy", "victoria": "vicky", "william": "bill will billy wm willy",
}
FULL: dict[str, tuple[str, ...]] = {}
for _full, _short in NICK.items():
    for _s in _short.split():
        FULL[_s] = (*FULL.get(_s, ()), _full)

#: Indic consonants and signs by their place in a script's block (all blocks share the places).
_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh n ch chh j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh sh s h".split()))
_VOWELS = dict(zip(range(0x05, 0x15), "a a i i u u r l e e e e o o o o".split()))
_SIGNS = dict(zip(range(0x3E, 0x4D), "a i i u u r r e e e e o o o o".split()))


def distance(a: str, b: str, limit: int) -> int:
    """Edit distance with neighbouring letters exchanged as one edit; ``limit`` + 1 where it is more. One machine word holds a column."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, diagonal, last, score = full, 0, 0, 0, len(a)
    for c in b:
        here = places.get(c, 0)
        diagonal = ((((here & up) + up) ^ up) | here | down | (((~diagonal & here) << 1) & last)) & full
        plus, minus = down | (full & ~(diagonal | up)), diagonal & up
        score += bool(plus & top) - bool(minus & top)
        plus, minus = ((plus << 1) | 1) & full, (minus << 1) & full
        up, down, last = minus | (full & ~(diagonal | plus)), plus & diagonal, here
    return min(score, limit + 1)


def struck(word: str, n: int) -> set[str]:
    """The word with up to ``n`` letters struck out."""
    out = now = {word}
    for _ in range(n):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        out = out | now
    return out


def shortened(a: str, b: str) -> bool:
    """Is ``a`` a short form of ``b``: the same first letter, then letters of b in their order?"""
    if not 2 <= len(a) < len(b) or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


def is_latin(name: str) -> bool:
    """Reads as Latin script: no letter of another script once look-alikes are rewritten."""
    if name.isascii():
        return True
    return not any(unicodedata.category(c)[0] in "LM" and "LATIN" not in unicodedata.name(c, "") and not unicodedata.combining(c) for c in fold(name))


def transliterate(text: str) -> str:
    """Indic letters to plain Latin ones, vowel length left out."""
    out: list[str] = []
    bare = False  # the last sign was a consonant that still carries its own vowel
    for c in text:
        code = ord(c)
        if 0x0900 <= code < 0x0D80:
            at = code & 0x7F
            if at in _CONSONANTS:
                out.append("a" if bare else "")
                out.append(_CONSONANTS[at])
                bare = True
                continue
            if at in _SIGNS:
                out.append(_SIGNS[at])
            elif at in _VOWELS:
                out.append(("a" if bare else "") + _VOWELS[at])
            elif at == 0x4D:
                pass
            elif at in (0x01, 0x02):
                out.append(("a" if bare else "") + "n")
            elif at == 0x3C:
                continue
            bare = False
        else:
            if bare and c.isalpha():
                out.append("a")
            bare = False
            out.append(c)
    return "".join(out)


@lru_cache(maxsize=200_000)
def plain_digits(token: str) -> tuple[str, ...]:
    """Readings of a word with digits for letters; the word itself where it has none or is a number."""
    if not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token):
        return (token,)
    base = token.translate(str.maketrans("03457", "oeast"))
    guess = ""
    for i, c in enumerate(base):
        if c == "1":
            left, right = base[i - 1] if i else "", base[i + 1] if i + 1 < len(base) else ""
            c = "l" if (not left or left in "aeiou") else "i" if (not right or right not in "aeiou1") else "l"
        guess += c
    return tuple(dict.fromkeys([guess, base.replace("1", "l"), base.replace("1", "i")]))


@lru_cache(maxsize=200_000)
def is_legal(token: str) -> bool:
    return any(w in LEGAL or (len(w) >= 6 and any(distance(w, x, 2) <= (1 if len(x) < 7 else 2) for x in LEGAL_LONG)) for w in plain_digits(token))


@lru_cache(maxsize=200_000)
def is_general(word: str) -> bool:
    return word in GENERAL or any(len(g) >= 6 and distance(word, g, 1) <= 1 for g in GENERAL)


def tokens_of(text: str) -> list[str]:
    """Words of a folded text; single letters in a row are one word (``l l c``, ``s.a.r.l.``)."""
    out: list[str] = []
    run = ""
    for w in re.findall(r"[^\W_]+", re.sub(r"['’]", "", text)):
        if len(w) == 1:
            run += w
            continue
        if run:
            out.append(run)
            run = ""
        out.append(w)
    return [*out, run] if run else out


def name_words(text: str) -> list[str]:
    """The words of a name proper: no legal forms, no additions, no word twice in a row."""
    words: list[str] = []
    for w in tokens_of(text):
        if is_legal(w):
            continue
        w = plain_digits(w)[0]
        if words and (words[-1] == w or (len(w) >= 5 and distance(words[-1], w, 2) <= (1 if len(w) < 8 else 2))):
            continue
        words.append(w)
    return [w for w in words if not is_general(w)] or words


def trade_edits(trade: str) -> int:
    """Edits up to which a word is a misspelling of the trade word."""
    return 0 if len(trade) < 6 else 1 if len(trade) < 7 else 2


class Trades:
    """The trade words of one country, and what a typed word may stand for."""

    def __init__(self, words: list[str]):
        self.words = frozenset(words)
        self.by_letter: dict[str, list[str]] = {}
        self.by_rest: dict[str, list[str]] = {}
        self.longest = max(map(len, words), default=0)
        for w in sorted(words):
            self.by_letter.setdefault(w[0], []).append(w)
            # by what is left of it with letters struck out, as near spellings share a rest
            for rest in struck(w, trade_edits(w)):
                self.by_rest.setdefault(rest, []).append(w)
        self.memo: dict[str, tuple[str, ...]] = {}

    def typed(self, word: str) -> tuple[str, ...]:
        """Trade words that the word is a misspelling of, else those it is a short form of."""
        if word in self.words:
            return (word,)
        found = self.memo.get(word)
        if found is None:
            maybe = {t for rest in struck(word, 2) for t in self.by_rest.get(rest, ())} if len(word) <= self.longest + 2 else set()
            near = tuple(t for t in sorted(maybe) if distance(word, t, 2) <= trade_edits(t))
            found = near or tuple(t for t in self.by_letter.get(word[:1], ()) if shortened(word, t) or (word.endswith("s") and shortened(word[:-1], t)))
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[word] = found
        return found


@lru_cache(maxsize=256)
def trades_of(words: tuple[str, ...]) -> Trades:
    """One index a worker and list."""
    return Trades(list(words))


def stands_for_trade(word: str, trade: str) -> bool:
    """A misspelling or a short form of the trade word, or the word itself."""
    return word == trade or distance(word, trade, 2) <= trade_edits(trade) or shortened(word, trade) or (word.endswith("s") and shortened(word[:-1], trade))


def reference_reading(name: str | None, trades: Trades) -> list[tuple[str, str, str]]:
    """(key, trade, words) of a clean name: under its words, and under the initial where it begins with a given name."""
    words = name_words(fold(name))
    if not words:
        return []
    trade = words[-1] if len(words) > 1 and words[-1] in trades.words else ""
    core = words[:-1] if trade else words
    out = [("".join(core), trade, " ".join(core))]
    if core[0] in NICK and len(core) > 1:
        out.append((core[0][0] + "".join(core[1:]), trade, " ".join([core[0][0], *core[1:]])))
    return out


def typed_readings(name: str | None, trades: Trades, longest: int = 1 << 20) -> list[tuple[str, str, str]]:
    """(key, trades, words) of a name as typed; ``trades`` are the possible trade words joined by "|", "" where none is said. What is
    longer than ``longest`` letters, and so like no name of the reference, has its plain reading only."""
    text = re.sub(r"^[\W_]+(?=[\w@#])", lambda m: m[0][-1] if m[0][-1] in "@#" else "", transliterate(fold(name)).strip())
    if not text:
        return []
    found: dict[tuple[str, str], str] = {}
    m = DOMAIN.match(text) or HANDLE.match(text)
    if m:
        for stem in plain_digits(re.sub(r"[-_]", "", m[1])):
            found.setdefault((stem, ""), stem)
            for t in trades.words:
                if stem.endswith(t) and len(stem) > len(t) + 2:
                    found.setdefault((stem[: -len(t)], t), stem[: -len(t)])
        return [(k, t, w) for (k, t), w in found.items()]
    indic = any("\u0900" <= c < "\u0d80" for c in name)
    for part in ALIAS.split(" " + text + " "):
        words = name_words(part)
        if not words:
            continue
        if indic:
            # loan words are spelt by sound there: the trade and the legal form may be any of the last words
            for n in range(1, len(words) + 1):
                key = "".join(words[:n])
                if n > 1 and len(key) > longest:
                    break
                found.setdefault((key, ""), " ".join(words[:n]))
            continue
        if sum(map(len, words)) > longest + trades.longest + 2:
            found.setdefault(("".join(words), ""), " ".join(words))
            continue
        said = [i for i, w in enumerate(words) if w in trades.words]
        options: list[tuple[list[str], str]] = []
        if said and len(words) > 1:
            # of several trade words the last is the trade; the others may belong to the name
            at = said[-1]
            options.append((words[:at] + words[at + 1 :], words[at]))
            if len(said) > 1:
                at = said[0]
                options.append((words[:at] + words[at + 1 :], words[at]))
        else:
            options.append((words, ""))
        if not said and len(words) > 1:
            options += [(words[:i] + words[i + 1 :], "|".join(t)) for i, w in enumerate(words) if (t := trades.typed(w))]
        for core, trade in options:
            core = [c for i, c in enumerate(core) if not i or c != core[i - 1]]
            for given in _given(core):
                for i in range(len(given)):
                    turn = given[i:] + given[:i]
                    found.setdefault(("".join(turn), trade), " ".join(turn))
    return [(k, t, w) for (k, t), w in found.items()]


def _given(core: list[str]) -> list[list[str]]:
    """The words, and with each short given name in full."""
    out = [core]
    for i, w in enumerate(core):
        for full in FULL.get(w, ()):
            out.append([*core[:i], full, *core[i + 1 :]])
    return out


def trade_fits(typed: str, trade: str) -> bool:
    """No trade word on one side, or the same on both."""
    return not typed or not trade or trade in typed.split("|")
