"""Analysis of words for retrieval: stop lists by language, and Porter's published suffix stripping for English.

An analyzer turns a text into the array of its terms, one place a word, with null where a stop word stands: places count
every word, so phrases keep their gaps. Index, queries and headlines must use the same one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"

# Stop lists.
STOP_LISTS = {
    "english": "a an and are as at be but by for from had has have he her his i if in into is it its of on or our she so that the their they this to was we were what when which who will with you".split(),
    "german": "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für im in ist mit nicht oder sie sich und von war wie wir zu zum zur".split(),
    "french": "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui sa se son sur un une vous".split(),
    "spanish": "a al con de del el en es ese esta este la las lo los más mi no o para pero por que se sin su sus un una y ya".split(),
    "simple": [],
}
# The suffixes of the published algorithm's second, third and fourth step, with what takes their place.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

# A consonant y is Y while a word is worked on, so vowels are these six and all else is a consonant.
VOWEL, REST = "[aeiouy]", "[^aeiouy]"
#: Stems of one or more, of just one, and of two or more turns from vowel to consonant.
SOME, ONE, MANY = f"^{REST}*{VOWEL}+{REST}", f"^{REST}*{VOWEL}+{REST}+{VOWEL}*$", f"^{REST}*{VOWEL}+{REST}+{VOWEL}+{REST}"
#: A short end: consonant, vowel, consonant, the last not w, x or y.
SHORT = f"{REST}{VOWEL}[^aeiouywxY]$"
DOUBLE = f"(?:{'|'.join(2 * c for c in 'bcdfghjkmnpqrtvwx')})$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ending(suffixes) -> str:
    """The longest of the suffixes at the end of a word."""
    return f"^.*?({'|'.join(suffixes)})$"


def _strip(word: Column, suffixes, then: Callable[[Column, Column], Column]) -> Column:
    """The word, or ``then(stem, suffix)`` where one of the suffixes ends it; null of that keeps the word."""
    cut = lambda w: let(F.regexp_extract(w, ending(suffixes), 1), lambda s: F.when(s == "", w).otherwise(F.coalesce(then(F.left(w, F.length(w) - F.length(s)), s), w)))
    return let(word, cut)


def _replaced(word: Column, table: dict[str, str]) -> Column:
    values = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return _strip(word, table, lambda stem, s: F.when(stem.rlike(SOME), F.concat(stem, F.element_at(values, s))))


def _mended(stem: Column) -> Column:
    """A stem after -ed or -ing went."""
    longer = stem.rlike("(?:at|bl|iz)$") | (stem.rlike(ONE) & stem.rlike(SHORT))
    return F.when(stem.rlike(DOUBLE), F.left(stem, F.length(stem) - 1)).when(longer, F.concat(stem, F.lit("e"))).otherwise(stem)


def stem(word: Column) -> Column:
    """The stem of a lower-case English word; words of one or two letters, or with other signs than a-z, stay."""
    w = F.regexp_replace(word, "(^|[aeiouy])y", "$1Y")
    plural = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
    values = F.create_map(*[F.lit(x) for pair in plural.items() for x in pair])
    w = _strip(w, plural, lambda stem, s: F.concat(stem, F.element_at(values, s)))
    w = _strip(w, ("eed", "ed", "ing"), lambda stem, s: F.when(s == "eed", F.when(stem.rlike(SOME), F.concat(stem, F.lit("ee")))).when(stem.rlike(VOWEL), _mended(stem)))
    w = _strip(w, ("y", "Y"), lambda stem, s: F.when(stem.rlike(VOWEL), F.concat(stem, F.lit("i"))))
    w = _replaced(_replaced(w, SECOND), THIRD)
    w = _strip(w, FOURTH, lambda stem, s: F.when(stem.rlike(MANY) & ((s != "ion") | stem.rlike("[st]$")), stem))
    w = _strip(w, ("e",), lambda stem, s: F.when(stem.rlike(MANY) | (stem.rlike(ONE) & ~stem.rlike(SHORT)), stem))
    w = _strip(w, ("l",), lambda stem, s: F.when(stem.rlike("l$") & F.concat(stem, s).rlike(MANY), stem))
    return F.when(word.rlike("^[a-z]{3,}$"), F.lower(w)).otherwise(word)


@dataclass(frozen=True)
class Words:
    """An analyzer that works word by word: ``term`` of each of a text's words, null where one does not count."""

    term: Callable[[Column], Column]

    def split(self, text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def __call__(self, text: Column) -> Column:
        return F.transform(self.split(text), lambda w: self.term(w))


def analyzer(language: str = "english") -> Words:
    """The analyzer of a language of ``STOP_LISTS``: English words are stemmed, those of other languages stay."""
    stops = STOP_LISTS[language]
    ends = stem if language == "english" else (lambda w: w)
    return Words((lambda w: F.when(~w.isin(*stops), ends(w))) if stops else ends)
