"""Scalar text rules as Column expressions; only Unicode normalisation needs Python (Arrow)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that are no keywords.
STOP_WORDS = (
    "and the for are but not you all can had her was one our out day get has him his how man new now old see two way who boy "
    "did its let put say she too use may will would could should might must shall cannot this that these those such very just only "
    "about after again against before being below between both during each from further having into more most other over same some than "
    "through under until where while with without "
    "있습니다 같습니다 됩니다 합니다 입니다 때문에 그리고 하지만 또한 이것은 그것은 아니다 아닙니다 무엇 어떤 어떻게 언제 어디서 누가 "
    "그런데 그러나 그래서 따라서 그렇지만 그러므로 그러니까 이런 저런 그런 이러한 저러한 그러한 이렇게 저렇게 그렇게 습니다 았습니다 었습니다 했습니다 "
    "이다 하다 되다 있다 없다 같다 다르다 우리 저희 그들 이들 저들 여러분 자신 서로 여기 저기 거기 어기 이곳 저곳 그곳 "
    "지금 그때 항상 가끔 때때로 자주 늘 그냥 단지 오직 단순히 정말 진짜 사실 실제로"
).split()
#: Particles that may end a noun, in the order in which they are tried.
PARTICLES = "의 에서의 으로는 로는 에서는 으로도 로도 와도 과도 에는 에도 까지 부터 보다 처럼 같이 하고 한테 에게 이 가 께서 을 를 에서 으로 로 와 과 랑 께 에 도 만 이다 다 은 는".split()
#: Stems that are no words of a keyword.
STEM_STOPS = ("이다", "있다", "없다", "되다", "하다", "그것", "것이", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
#: The particles of which the longest that fits is taken off.
LONGEST_PARTICLES = (
    "이", "가", "을", "를", "의", "에", "에서", "에게", "한테", "으로", "로",
    "와", "과", "하고", "이랑", "랑", "아", "야", "이여", "여",
    "은", "는", "도", "만", "까지", "부터", "조차", "마저", "밖에", "뿐",
)
#: Blocks whose characters cleaning removes, and single ones outside them.
REMOVED = (
    r"\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}\x{FFF0}-\x{FFFF}"
    r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{0590}-\x{074F}\x{0750}-\x{077F}\x{0800}-\x{0DFF}"
    r"\x{1680}-\x{16FF}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}\x{0300}-\x{036F}\x{04C2}\x{04DD}\x{0561}\x{07C8}"
)
WHITE = r"[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Characters that do not belong in a keyword, and those that do.
SUSPICIOUS = r"[\x{0590}-\x{074F}\x{0750}-\x{077F}\x{0900}-\x{0D7F}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{E000}-\x{F8FF}\x{FFF0}-\x{FFFF}]"
NORMAL = r"[\x{20}-\x{7F}\x{A0}-\x{017F}\x{AC00}-\x{D7AF}\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
TOKEN = r"[\p{L}\p{N}_]+"
#: The separators of words, as Unicode names them; line ends and tabs are none.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def trim(text: Column) -> Column:
    """A text without spaces of any kind at its ends. It has one argument: to `F.trim` an array function also hands an element's index, whose digits then go instead of spaces."""
    return F.trim(text, F.lit(SPACES))


def clean_text(text: Column) -> Column:
    """One line of normalised text without control, broken or foreign-block characters."""
    kept = F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), f"[{REMOVED}]", "")
    return F.trim(F.regexp_replace(kept, WHITE, " "))


def has_letter_or_number(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def is_meaningful(keyword: Column) -> Column:
    """Whether a string may be a keyword."""
    k = F.trim(keyword)
    share = lambda pattern: F.regexp_count(k, F.lit(pattern)) / F.greatest(F.length(k), F.lit(1))
    return (
        F.length(k).between(2, 50)
        & has_letter_or_number(k)
        & ~k.rlike(r"^\p{Nd}+$")
        & ~((F.length(k) > 2) & k.rlike(r"^(.)\1+$"))
        & (share(SUSPICIOUS) <= 0.25)
        & (share(NORMAL) >= 0.5)
        & ~F.lower(k).isin(STOP_WORDS)
        & ~k.rlike(r"^<[^>]+>$")
    )


def valid_words(text: Column, least: int = 2) -> Column:
    """Different Hangul, Latin and mixed words of a text that may be keywords, in that order."""
    runs = [f"[가-힣]{{{least},}}", f"[A-Za-z]{{{max(3, least)},}}", f"[A-Za-z가-힣][A-Za-z가-힣0-9]{{{least - 1},}}"]
    found = F.concat(*[F.regexp_extract_all(text, F.lit(r), 0) for r in runs])
    return F.filter(F.array_distinct(found), is_meaningful)


def filter_keywords(keywords: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(keywords, is_meaningful)), 1, most)


def strip_particle(word: Column) -> Column:
    """The stem of a word that ends with a particle, if two characters or more remain; the first particle that fits counts."""
    out = F.when(~word.rlike("[가-힣]"), word)
    for p in PARTICLES:
        out = out.when((F.length(word) >= len(p) + 2) & word.endswith(p), word.substr(F.lit(1), F.length(word) - len(p)))
    return out.otherwise(word)


def strip_particle_longest(word: Column) -> Column:
    """The stem of a word without the longest of its own list of particles that leaves two characters or more; shorter words are empty."""
    out = F.when(F.length(word) < 2, "")
    for p in sorted(LONGEST_PARTICLES, key=len, reverse=True):
        out = out.when((F.length(word) >= len(p) + 2) & word.endswith(p), word.substr(F.lit(1), F.length(word) - len(p)))
    return out.otherwise(word)


def normalize_keyword(keyword: Column) -> Column:
    return strip_particle(F.trim(F.regexp_replace(nfc(keyword), WHITE, " ")))


def keyword_to_words(keyword: Column) -> Column:
    """A keyword of one or two words whole, a longer one as its stems; the phrase itself if none remains."""
    parts = F.filter(F.split(keyword, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)
    stems = F.filter(F.transform(parts, strip_particle_longest), lambda w: ~F.lower(w).isin(*STEM_STOPS))
    return (
        F.when(F.size(F.split(F.trim(keyword), WHITE)) <= 2, F.array(strip_particle_longest(keyword)))
        .when(F.size(stems) > 0, stems)
        .otherwise(F.array(keyword))
    )


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


def squeeze_ocr(text: Column) -> Column:
    """Lines squeezed one by one, table lines untouched, long gaps cut to one blank line."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.contains("|"), x).otherwise(squeeze(x)))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{4,}", "\n\n"))


def detect_language(text: Column) -> Column:
    """ko if over a tenth of the first 1000 characters is Hangul, en if over half are ASCII letters, else unknown."""
    head = F.substring(text, 1, 1000)
    n = F.greatest(F.length(head), F.lit(1))
    return (
        F.when(F.regexp_count(head, F.lit("[가-힣]")) / n > 0.1, "ko")
        .when(F.regexp_count(head, F.lit("[A-Za-z]")) / n > 0.5, "en")
        .otherwise("unknown")
    )


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def count_sentences(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[.!?。！？]+\s"), lambda s: F.trim(F.regexp_replace(s, WHITE, " ")) != ""))


def text_quality(text: Column) -> Column:
    """Length, word variety, punctuation and share of letters, as one number up to 1."""
    n, w = F.length(text), words(text)
    return F.when(n == 0, 0.0).otherwise(
        F.least(n / 1000, F.lit(1.0)) * 0.3
        + F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w) * 0.3).otherwise(0.0)
        + F.least(F.regexp_count(text, F.lit("[.!?,:;]")) / n * 100, F.lit(1.0)) * 0.2
        + F.regexp_count(text, F.lit(r"[\p{L}\p{N}\s]")) / n * 0.2
    )


def charset_quality(text: Column) -> Column:
    """Shares of normal, suspicious and white characters and of words, as one number up to 1."""
    t = F.trim(text)
    n, w = F.length(t), words(t)
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    normal = share(r"[\x{20}-\x{7F}\x{A0}-\x{FF}\x{AC00}-\x{D7AF}\x{4E00}-\x{9FFF}\x{3000}-\x{303F}]")
    bad = share(r"[\x{0590}-\x{06FF}\x{0900}-\x{0DFF}\x{E000}-\x{F8FF}\x{FFF0}-\x{FFFF}]")
    real = F.size(F.filter(w, lambda x: (F.length(x) >= 2) & x.rlike(r"[\p{L}\p{N}]"))) / F.greatest(F.size(w), F.lit(1))
    return F.when(n == 0, 0.0).otherwise(normal * 0.4 + (1 - bad) * 0.3 + F.least(F.lit(0.3), 1 - share(r"\s")) * 0.2 + real * 0.1)
