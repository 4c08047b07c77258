"""Result lines on screen: their grammar, their language, the name they end with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let
from .unicode import compact, nfkc, spaced

# The action words at the head of a line.
HEAD = r"(?i)^(?:(?:ASSIST|助攻)\s*[,.:，：]*\s*|KN[O0]CK(?:ED)?\s*D[O0]WN\s*|ELIMINAT(?:ED|ION)\s*|(?:已)?[擊击擎驛驿]倒\s*|(?:已)?消[滅灭減减]\s*|淘汰\s*)"
POINTS = r"\s*\+\s*[0-9OoIiLlSsBbZz]{1,5}(?:\s|$|[^A-Za-z0-9]).*$"
EDGE = " ,:;，：；"
NOT_IN_TARGETS = r"[\x00-\x1f�<>:=+!?！？。]"
TARGET_CAPTIONS = "(?i)DAMAGE|INFLICT|SHIELDBROKEN|YOUSPOTTED|SPOTTEDANENEMY|PRESS|HOLD|TOGGLE|RELOAD|ELIMINAT|KNOCK|KN0CK|ASSIST|SQUAD|擊倒|击倒|造成|傷害|伤害|護盾|护盾|按住|按下|切換|切换|你發現|你发现|我被|你被"
CUT_WORDS = "^(?:KN[O0]?(?:C(?:K(?:ED)?)?)?|D[O0]WN|ELIM|ELIMIN|ELIMINA|ELIMINATE|XP|RP)$"
CYRILLIC, LATIN = "АВЕКМНОРСТУХЗДИЙЛПЯЬЫ", "ABEKMHOPCTYX3ANNANRbb"
RU_ASSIST_KNOCK = r"^C[O0]A[EF][MNH][CG]T[BV][NM][EF]\s*[BV]\s*H[O0]KA[YV]T[EF]\s*"
RU_KNOCK = r"^H[O0]KA[YV]T(?![-—–])\s*"
CUE = r"(?i)擊倒|击倒|消滅|消灭|淘汰|助攻|KNOCK|ELIMINAT|H[O0]KA[YV]T|C[O0]A[EF][MNH][CG]T[BV]|撃倒"
ASSIST = r"(?i)^(?:助攻\s*[,，:]?\s*|ASSIST\s*[: ,]*\s*)\s*"
KNOCK = r"(?i)^(?:(?:已)?(?:擊倒|击倒)|KNOCKED DOWN)\s*"
ELIMINATION = r"(?i)^(?:已消滅|已消灭|ELIMINATED)\s*"
ASSIST_KNOCK, ASSIST_ELIMINATION = r"(?i)^(?:[擊击撃擎驛驿]倒|KNOCK(?:ED)? DOWN)\s*", r"(?i)^(?:(?:已)?消[滅灭減减]|淘汰|ELIMINAT(?:ION|ED))\s*"
# Spellings of the head that readers confuse, and what each is read as, in this order.
REPAIRS = (
    (r"^(助攻\s*[,，:：]?\s*)?撃倒", "$1擊倒"),
    (r"(?i)^KN[O0]CKED\s*D[O0]WN\s*", "KNOCKED DOWN "),
    (r"(?i)^ELIMINATED\s*", "ELIMINATED "),
    (r"(?i)^ASSIST\s*", "ASSIST "),
    (r"(?i)^ASSIST\s*[,.:]*\s*KN[O0]CK(?:ED)?\s*D[O0]WN\s*", "ASSIST KNOCKED DOWN "),
    (r"(?i)^ASSIST\s*[,.:]*\s*ELIMINAT(?:ION|ED)\s*", "ASSIST ELIMINATED "),
)
# Fixed values: (kind, action, English, head) of the lines that can be proved, the first that fits counts.
PREFIXES = (
    ("assist", "knock", True, r"(?i)^ASSIST\s*[,.:]*\s*KN[O0]CK(?:ED)?\s*D[O0]WN\s*"),
    ("assist", "elimination", True, r"(?i)^ASSIST\s*[,.:]*\s*ELIMINAT(?:ED|ION)\s*"),
    ("assist", "knock", False, r"^助攻\s*[,，:：]*\s*[擊击撃擎驛驿]倒\s*"),
    ("assist", "elimination", False, r"^助攻\s*[,，:：]*\s*(?:已)?消[滅灭減减]\s*"),
    ("knock", "knock", True, r"(?i)^KN[O0]CKED\s*D[O0]WN\s*"),
    ("elimination", "elimination", True, r"(?i)^ELIMINATED\s*"),
    ("knock", "knock", False, r"^(?:已)?[擊击撃]倒\s*"),
    ("elimination", "elimination", False, r"^已消[滅灭]\s*"),
)
# Titles of the screens at the end and at the start of a round.
WIN = ("YOUARETHECHAMPION", "你已成为冠军", "你已成為冠軍", "你是冠军", "你是冠軍")
END = ("小队全灭", "小隊全滅", "游戏结束", "遊戲結束", "SQUADELIMINATED", "GAMEOVER")
LOADING = ("積分賽", "排位賽", "排位赛", "积分赛", "大逃殺", "大逃杀", "RANKEDLEAGUES")


def clean_target(text: Column, square: bool = False) -> Column:
    """The name a line ends with, without action words, points and captions; the empty text if no name can be read."""
    return _target(spaced(F.coalesce(text, F.lit(""))), square)


def _target(target: Column, square: bool = False) -> Column:
    """clean_target of a text that is normalised."""
    for _ in range(3):
        target = F.regexp_replace(target, HEAD, "")
    target = F.btrim(F.regexp_replace(target, POINTS, ""), F.lit(EDGE))

    def judged(t: Column) -> Column:
        dense = F.upper(F.regexp_replace(t, r"(?U)\s+", ""))
        named = t.rlike(r"\p{L}") | t.rlike("^[0-9]{5,20}$")
        wrong = t.rlike(NOT_IN_TARGETS) | let(dense, lambda d: d.rlike(TARGET_CAPTIONS) | d.rlike(CUT_WORDS))
        if not square:
            wrong = wrong | t.contains("□")
        return F.when(F.length(t).between(1, 48) & named & ~wrong, t).otherwise(F.lit(""))

    return let(target, judged)


def latin_look(text: Column) -> Column:
    """Cyrillic capitals as the Latin letters a reader without Cyrillic takes them for."""
    return F.translate(text, CYRILLIC, LATIN)


def _row(kind: Column, action: Column, raw: Column, text: Column, locale: Column) -> Column:
    return let(F.btrim(raw), lambda r: F.struct(kind.alias("kind"), action.alias("action"), _target(r).alias("target_text"), r.alias("target_raw"), text.alias("text"), locale.alias("locale")))


def _assist(after: Column, fixed: Column) -> Column:
    """The row of an assist: what follows names the action, if it can be read."""
    kind, locale = F.lit("assist"), result_locale(fixed)
    knocked = _row(kind, F.lit("knock"), F.regexp_replace(after, ASSIST_KNOCK, ""), fixed, locale)
    ended = _row(kind, F.lit("elimination"), F.regexp_replace(after, ASSIST_ELIMINATION, ""), fixed, locale)
    return F.when(after.rlike(ASSIST_KNOCK), knocked).when(after.rlike(ASSIST_ELIMINATION), ended).otherwise(_row(kind, F.lit("unknown"), after, fixed, locale))


def _line(clean: Column) -> Column:
    """result_line of a text that is normalised."""
    fixed = clean
    for pattern, to in REPAIRS:
        fixed = F.regexp_replace(fixed, pattern, to)
    tail = lambda look, head: F.substring(clean, F.length(F.regexp_extract(look, head, 0)) + 1, F.length(clean))
    russian = lambda look, kind, head: _row(F.lit(kind), F.lit("knock"), tail(look, head), clean, F.lit("ru"))
    own = lambda f, kind, head: _row(F.lit(kind), F.lit(kind), F.regexp_replace(f, head, ""), f, result_locale(f))
    other = let(fixed, lambda f: F.when(f.rlike(ASSIST), let(F.btrim(F.regexp_replace(f, ASSIST, "")), lambda after: _assist(after, f))).when(f.rlike(KNOCK), own(f, "knock", KNOCK)).when(f.rlike(ELIMINATION), own(f, "elimination", ELIMINATION)))
    return let(latin_look(clean), lambda look: F.when(look.rlike(RU_ASSIST_KNOCK), russian(look, "assist", RU_ASSIST_KNOCK)).when(look.rlike(RU_KNOCK), russian(look, "knock", RU_KNOCK)).otherwise(other))


def result_line(text: Column) -> Column:
    """struct(kind, action, target_text, target_raw, text, locale) of a line that starts with an own result; else null."""
    return let(spaced(text), _line)


def result_locale(text: Column) -> Column:
    """The language of a line by its action word; it chooses how the line is confirmed, never what it means."""
    return (
        F.when(text.rlike(r"(?i)^(?:ASSIST|KNOCKED DOWN|ELIMINATED)\b"), "en")
        .when(text.rlike(RU_ASSIST_KNOCK) | text.rlike(RU_KNOCK), "ru")
        .when(text.rlike(r"^(?:助攻\s*[,，:：]?\s*)?(?:擊倒|已消滅)"), "zh-TW")
        .when(text.rlike(r"^(?:助攻\s*[,，:：]?\s*)?(?:击倒|已消灭|淘汰)"), "zh-CN")
        .otherwise("zh")
    )


def known_dialogue(text: Column) -> Column:
    """Whether a line is speech: a speaker's colon, or an action word inside a sentence about somebody."""

    def judged(plain: Column) -> Column:
        own_head = plain.rlike("(?i)^(?:助攻|ASSIST|已消滅|已消灭|擊倒|击倒|KNOCKED|ELIMINATED)")
        line = _line(F.btrim(F.regexp_replace(plain, r"(?U)\s+", " ")))
        first = F.regexp_replace(plain, f"(?s)(?:{CUE}).*$", "")
        told = let(first, lambda b: b.contains(":") | b.rlike("(?i)我被|你被|被人|I(?: AM| WAS)? |YOU(?: ARE| WERE)? ")) | (line.isNull() & plain.rlike("[。!?！？]"))
        return F.when(plain.contains(":") & ~own_head, True).when(~plain.rlike(CUE), False).otherwise(told)

    return let(nfkc(text), judged)


def grammar_confirmable(after_dialogue: Column, target_text: Column, target_raw: Column) -> Column:
    """Whether grammar alone may confirm a line: not right after speech, and its rest does not read like a sentence."""
    raw = F.btrim(F.coalesce(target_raw, F.lit("")))
    fits = (raw == "") | ((F.length(raw) <= 24) & ~raw.rlike("[。！？!?，,：:；;、]"))
    return ~F.coalesce(after_dialogue, F.lit(False)) & (F.coalesce(target_text != "", F.lit(False)) | fits)


def classification_prefix(text: Column) -> Column:
    """struct(kind, action, english, length) of the first provable head of a line; else null."""

    def first(value: Column) -> Column:
        out = F.lit(None)
        for kind, action, english, head in reversed(PREFIXES):
            found = F.struct(F.lit(kind).alias("kind"), F.lit(action).alias("action"), F.lit(english).alias("english"), F.length(F.regexp_extract(value, head, 0)).alias("length"))
            out = F.when(value.rlike(head), found).otherwise(out)
        return out

    return let(spaced(text), first)


def _any_of(text: Column, titles: tuple[str, ...]) -> Column:
    return text.rlike("|".join(titles))


def round_result(text: Column, inactive: Column) -> Column:
    """'win' or 'end' by the titles of a round's last screens ('end' only outside the own view); else null."""
    key = compact(text)
    return F.when(_any_of(key, WIN), "win").when(F.coalesce(inactive, F.lit(False)) & _any_of(key, END), "end")


def loading_title(text: Column) -> Column:
    return _any_of(compact(text), LOADING)


def own_target(target_text: Column, target: Column, text: Column, confidence: Column) -> Column:
    """The name to show for a result: the read target, else the target, else what the whole line ends with; unsure ones: null."""
    line = F.when(spaced(text).rlike(HEAD), clean_target(text))
    shown = F.when(target_text.isNotNull(), clean_target(target_text)).when(target.isNotNull(), clean_target(target)).otherwise(line)
    return F.when(~F.coalesce(confidence < 0.8, F.lit(False)), F.nullif(shown, F.lit("")))
