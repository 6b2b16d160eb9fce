"""Scalar functions on text, as column expressions that stay in the JVM, and their plain versions for query texts."""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterable
from functools import cache, lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: What a lexicon matches on: a word of its own, or a phrase anywhere.
Lexicon = dict[str, list[str]]

# Names of colours and of actions, with the forms in which texts name them.
COLORS: Lexicon = {
    "red": ["đỏ", "red"], "orange": ["cam", "orange"], "yellow": ["vàng", "yellow"], "green": ["xanh lá", "xanh lục", "green"],
    "cyan": ["xanh ngọc", "cyan", "turquoise"], "blue": ["xanh dương", "xanh biển", "xanh da trời", "blue"], "purple": ["tím", "purple", "violet"],
    "pink": ["hồng", "pink"], "black": ["đen", "black"], "white": ["trắng", "white"], "gray": ["xám", "gray", "grey"],
}
ACTIONS: Lexicon = {
    "walking": ["đi bộ", "đi", "walking", "walk"], "running": ["chạy", "running", "run"], "standing": ["đứng", "standing", "stand"],
    "sitting": ["ngồi", "sitting", "sit"], "waving": ["vẫy tay", "vẫy", "waving", "wave"], "talking": ["nói chuyện", "nói", "talking", "speaking", "speak"],
    "holding": ["cầm", "giữ", "holding", "hold"], "cooking": ["nấu ăn", "nấu", "cooking", "cook"], "raking": ["cào", "raking", "rake"],
    "riding": ["đi xe", "cưỡi", "riding", "ride"], "driving": ["lái xe", "driving", "drive"], "dancing": ["nhảy múa", "múa", "dancing", "dance"],
    "singing": ["hát", "singing", "sing"], "eating": ["ăn", "eating", "eat"], "drinking": ["uống", "drinking", "drink"],
    "writing": ["viết", "writing", "write"], "reading": ["đọc", "reading", "read"], "playing": ["chơi", "playing", "play"],
    "working": ["làm việc", "working", "work"], "greeting": ["chào hỏi", "chào", "greeting", "greet"],
}


def lower(c: Column) -> Column:
    """Case folding as far as texts in these scripts need it: lower case, and ss for sharp s."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def tokens(c: Column) -> Column:
    """Words in lower case; a null text has none."""
    return F.coalesce(F.regexp_extract_all(lower(c), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


@cache
def accent_map() -> tuple[str, str]:
    """Composed letters and what is left of them without accents."""
    pairs = []
    for cp in range(0xC0, 0x2000):
        base, *marks = ud.normalize("NFD", chr(cp))
        if marks and all(ud.category(m) == "Mn" for m in marks):
            pairs.append((chr(cp), base))
    pairs += [("đ", "d"), ("Đ", "D")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def composing() -> list[tuple[str, str]]:
    """Letters with one more mark and what they compose to, so ordered that letters of several marks come after their parts.

    Marks above and below a letter compose in either order.
    """
    pairs = []
    for cp in range(0xC0, 0x2000):
        parts = ud.decomposition(chr(cp)).split()
        if len(parts) != 2 or parts[0].startswith("<") or ud.normalize("NFC", chr(cp)) != chr(cp):
            continue
        head, mark = (chr(int(x, 16)) for x in parts)
        if ud.category(mark) != "Mn":
            continue
        base, *marks = ud.normalize("NFD", chr(cp))
        pairs.append((len(marks), head + mark, chr(cp)))
        other = ud.normalize("NFC", base + marks[-1])
        if len(marks) == 2 and len(other) == 1 and ud.combining(marks[0]) != ud.combining(marks[1]):
            pairs.append((2, other + marks[0], chr(cp)))
    return [(a, b) for _, a, b in sorted(pairs)]


def compose(c: Column) -> Column:
    """Letters and their marks as composed letters; texts without marks of their own are left as they are."""
    pairs = constants(a + b for a, b in composing())
    cut = lambda p, i, n: F.substring(p, i, n)
    return F.when(c.rlike(r"\p{Mn}"), F.aggregate(pairs, c, lambda s, p: F.replace(s, cut(p, 1, 2), cut(p, 3, 1)))).otherwise(c)


def constants(items: Iterable[str]) -> Column:
    """An array of fixed texts, as one literal."""
    return F.split(F.lit("\n".join(items)), "\n")


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *accent_map()), r"\p{Mn}+", "")


def normalize(c: Column) -> Column:
    """Lower case without accents and punctuation, words separated by one space."""
    bare = F.regexp_replace(lower(strip_diacritics(c)), r"[^\p{L}\p{N}_\s]+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def words_of(normalized: Column) -> Column:
    """The words of a normalized text; none of an empty or null one."""
    return F.filter(F.split(F.coalesce(normalized, F.lit("")), " "), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of the text, padded with two spaces before and one after."""
    chars = F.regexp_extract_all(F.concat(F.lit("  "), c, F.lit(" ")), F.lit("(?s)(.)"), F.lit(1))
    n = F.size(chars) - 2
    part = lambda i: F.slice(chars, i, n)
    join = lambda a, b: F.concat(a, b)
    return F.array_distinct(F.zip_with(F.zip_with(part(1), part(2), join), part(3), join))


def lexicon_tags(c: Column, lexicon: Lexicon) -> Column:
    """The names of which some form occurs: single words as tokens, phrases anywhere in the text. Sorted."""
    names = [(name, form) for name, forms in lexicon.items() for form in forms]
    single = F.array(*[F.struct(F.lit(f).alias("form"), F.lit(n).alias("name")) for n, f in names if " " not in f])
    several = F.array(*[F.struct(F.lit(f).alias("form"), F.lit(n).alias("name")) for n, f in names if " " in f])

    def tags(x: Column) -> Column:
        hits = F.concat(F.filter(single, lambda p: F.array_contains(x["words"], p["form"])), F.filter(several, lambda p: F.contains(x["text"], p["form"])))
        return F.array_sort(F.array_distinct(F.transform(hits, lambda p: p["name"])))

    # a lambda over one element names the text and its words, which are then computed once
    return F.element_at(F.transform(F.array(F.struct(lower(c).alias("text"), F.array_distinct(tokens(c)).alias("words"))), tags), 1)


def contains_hint(c: Column, hints: list[str]) -> Column:
    """Whether any hint occurs anywhere, also inside a word."""
    text = lower(c)
    return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(text, h))


def json_object(c: Column) -> Column:
    """The JSON object in a text of a model: the one in a fence, else from the first brace to the last; null without one."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))


def phrase_level(phrase: Column, text: Column, threshold: float = 0.6) -> Column:
    """'exact', 'partial' (so many of the words), 'hit' (some) or 'miss' of a normalized phrase in a normalized text."""
    wanted, held = words_of(phrase), words_of(text)
    share = F.size(F.filter(wanted, lambda w: F.array_contains(held, w))) / F.size(wanted)
    return F.when(F.coalesce(phrase, F.lit("")) == "", "miss").when(F.contains(text, phrase), "exact").when(share >= threshold, "partial").when(share > 0, "hit").otherwise("miss")


def plain_strip(text: str) -> str:
    return "".join(c for c in ud.normalize("NFD", text) if not ud.combining(c)).replace("đ", "d").replace("Đ", "D")


def plain_normalize(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]+", " ", plain_strip(text).casefold()).split())


@lru_cache(maxsize=100_000)
def alike(a: str, b: str, ratio: float) -> bool:
    """Whether two words match nearly; the same words meet in very many pairs of texts."""
    from difflib import SequenceMatcher

    # both upper bounds are cheap and never below the ratio itself
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio


def token_containment(query: list[str], text: list[str], ratio: float = 0.8) -> float:
    """Share of query words that the text holds, exactly or nearly (sequence matching ratio)."""
    if not query:
        return 0.0
    held, near = set(text), 0
    by_length: dict[int, list[str]] = {}
    for w in dict.fromkeys(text):
        by_length.setdefault(len(w), []).append(w)
    for w in query:
        if w in held:
            near += 1
            continue
        slack = max(2, len(w) // 3)
        options = (x for n in range(len(w) - slack, len(w) + slack + 1) for x in by_length.get(n, ()))
        near += any(alike(w, x, ratio) for x in options)
    return near / len(query)


def phrase_ratio(query: str, text: str, least: float = 0.0) -> float:
    """Best sequence matching ratio of the query and a window of as many words of the text; 0 if it isn't above ``least``."""
    from difflib import SequenceMatcher

    q, t = query.split(), text.split()
    if not q or not t:
        return 0.0
    windows = [text] if len(t) <= len(q) else [" ".join(t[i : i + len(q)]) for i in range(len(t) - len(q) + 1)]
    best = least
    for window in dict.fromkeys(windows):
        m = SequenceMatcher(None, query, window)
        if m.real_quick_ratio() > best and m.quick_ratio() > best:
            best = max(best, m.ratio())
    return best if best > least else 0.0


def fuzzy_score(query: str, text: str, least: float = 0.0) -> float:
    """The score of two normalized texts; where it is below ``least``, any number below it."""
    held = 0.55 * token_containment(query.split(), text.split())
    # what the phrase must give; a little less, as scores are rounded before they are compared
    need = (least - held) / 0.45 - 1e-5
    return held + (0.45 * phrase_ratio(query, text, max(need, 0.0)) if need < 1 else 0.0)
