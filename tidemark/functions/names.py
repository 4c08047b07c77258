"""Player names: clan tags, keys, validity, closeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .unicode import casefold, letters_digits, nfkc

# The forms of a clan tag before a name, in the order in which they are cut.
TAGS = (
    r"^\[?[^\[\]\s]{1,6}\]\s*",
    r"^\[[A-Za-z0-9]{2,6}(?=[぀-ヿ㐀-鿿])",
    r"^\[[A-Za-z0-9]{2,6}\s+",
)
# Signs around a name that belong to icons, and what no name holds.
EDGE = " ()（）♫♪◀▶□"
NOT_IN_NAMES = r"[\x00-\x1f�:=+!?！？。]"
LOOSE_ARROW = r"(?U)(?<!\w)[<>]|[<>](?!\w)"
CAPTIONS = ("MAXLEVEL", "DEATHBOXRECOVERY", "RECOVERBANNER", "SPECTATING", "DAMAGEINFLICTED", "KNOCKEDDOWN", "ELIMINATED", "ASSIST")
CAPTION_WORDS = "傷害|伤害|造成|擊倒|击倒|消滅|消灭|助攻|進化|进化|等級|等级|下個|下个|回收|旗幟|旗帜|觀戰|观战"
DIGIT_NAME, SIGNED_DIGIT_NAME = r"^[0-9]{5,20}$", r"^[0-9]+(?:[<>]+[0-9]+)+$"
# Kana whose small form stands beside the plain one.
SMALL_KANA, PLAIN_KANA = "ぁぃぅぇぉっゃゅょゎゕゖァィゥェォッャュョヮヵヶ", "あいうえおつやゆよわかけアイウエオツヤユヨワカケ"
KANA = r"[ぁ-ゖァ-ヺ]"
# The words that may be told apart by blanks.
WORD, CLAN = "[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*", r"\[[A-Za-z0-9]{1,6}\]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_clan_tag(name: Column) -> Column:
    """The normalised name without a leading clan tag; an unknown name is empty."""
    bare = trimmed(nfkc(F.coalesce(name, F.lit(""))))
    return trimmed(reduce(lambda text, tag: F.regexp_replace(text, tag, ""), TAGS, bare))


def name_key(name: Column) -> Column:
    """Case-folded letters and digits of a name without its tag: names of one key are one player."""
    return letters_digits(casefold(strip_clan_tag(name)))


def glyph_family(key: Column) -> Column:
    """Runs of i and l, which look alike, as one i in keys of ten or more ASCII letters and digits."""
    return F.when(key.rlike("^[a-z0-9]{10,}$"), F.regexp_replace(key, "[il]+", "i")).otherwise(key)


def player_name(text: Column, square: bool = False) -> Column:
    """The name a reading holds, or the empty text if it cannot be one. square: a rendered square may be part of it."""
    bare = strip_clan_tag(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))

    def judged(name: Column) -> Column:
        named = name.rlike(r"\p{L}") | name.rlike(DIGIT_NAME) | (name.rlike(SIGNED_DIGIT_NAME) & (F.length(name) >= 4))
        wrong = name.rlike(NOT_IN_NAMES) | name.rlike(LOOSE_ARROW) | letters_digits(F.upper(name)).isin(*CAPTIONS) | name.rlike(CAPTION_WORDS)
        if not square:
            wrong = wrong | name.contains("□")
        return F.when(F.length(name).between(2, 40) & named & ~wrong, name).otherwise(F.lit(""))

    return let(F.btrim(bare, F.lit(EDGE)), judged)


def close_keys(left: Column, right: Column, least: int = 6) -> Column:
    """Whether two name keys are equal or at most one edit apart (two for long ones); shorter than ``least``: only if equal."""
    n, m = F.length(left), F.length(right)
    short = F.least(n, m)
    ascii_both = left.rlike(r"^\p{ASCII}*$") & right.rlike(r"^\p{ASCII}*$")
    limit = F.when((short >= 12) | ((short >= 10) & ascii_both), 2).otherwise(1)
    near = (short >= least) & (F.abs(n - m) <= limit) & (F.levenshtein(left, right) <= limit)
    return F.when(left == right, F.length(left) > 0).otherwise(near)


def close_name(left: Column, right: Column, least: int = 6) -> Column:
    return close_keys(name_key(left), name_key(right), least)


def kana_family(name: Column) -> Column:
    """The name with small kana as plain ones: readings of one family differ only in the size of kana."""
    return F.translate(name, SMALL_KANA, PLAIN_KANA)


def has_kana(name: Column) -> Column:
    return name.rlike(KANA)


def word_spaced(name: Column) -> Column:
    """Whether a name is made of plain words, blanks and at most one tag, so that its word breaks can be proved."""
    return (F.length(name) <= 48) & name.rlike(f"^(?:{CLAN} *)?{WORD}(?: +{WORD})*$")


def excluded_key(name: Column) -> Column:
    """Key of a player to leave out: the name key, or the lower-case name itself where it has no letters."""
    return F.coalesce(F.nullif(name_key(name), F.lit("")), F.lower(trimmed(nfkc(name))))


def compare_key(name: Column) -> Column:
    """Case-folded name without tag and with single blanks, for comparing two readings of one target."""
    return casefold(F.btrim(F.regexp_replace(strip_clan_tag(name), r"(?U)\s+", " ")))
