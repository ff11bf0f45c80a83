"""Which strings look the same on paper: the pairs, from the Unicode tables and a few fixed lists."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other alphabets drawn like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаесіјорѕухһԁԛԝӀӏ", "ABESIJKMHOPCTYXaecijopsyxhdqwIl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳρν", "ABEZHIKMNOPTYXocjpv"))
ARMENIAN = dict(zip("օՕոսհցզԼՏՍ", "oOnuhgqLSU"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZRVSLCPKB"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
LATIN = dict(zip("ɑɡ", "ag"))
# Strokes drawn like the hyphen-minus.
HYPHENS = "\u2010\u2011\u2212\ufe63\u02d7"
# Blanks drawn like the ordinary one.
BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Radicals without a decomposition, with the character each is drawn like.
RADICALS = dict(zip("⺁⺇⺈⺍⺎⺗⺜⺝⺟⺠⺩⺫⺬⺮⺳⺼⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻐⻑⻓⻔⻘⻙⻚⻛⻜⻝⻠⻢⻣⻤⻥⻦⻧⻨⻩⻫⻬⻭⻮⻯⻰⻱⻲⻳", "厂几刀⺌兀心日月母民王目示竹网肉虎衤覀西见角讠贝车辶钅長长门青韦页风飞食饣马骨鬼鱼鸟卤麦黄斉齐歯齿竜龙龜亀龟"))
#: Signs of category Cf that do show.
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Compatibility mappings that do not change the look, by block; of the other ones most do.
SAME_LOOK = ((0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0x2160, 0x217F), (0xB5, 0xB5))
HANGUL = (0xAC00, 0xD7A3)


def is_invisible(cp: int) -> bool:
    """Does the code point leave no mark on paper, not even a blank?"""
    if cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5) or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0000 <= cp <= 0xE0FFF:
        return True
    return unicodedata.category(chr(cp)) == "Cf" and cp not in VISIBLE_FORMAT and not 0x13430 <= cp <= 0x1345F


@cache
def invisible() -> tuple[str, ...]:
    return tuple(chr(cp) for cp in (*range(0x80, 0x20000), *range(0xE0000, 0xE1000)) if is_invisible(cp))


@cache
def look_alike_pairs() -> tuple[tuple[str, str], ...]:
    """Pairs (string, string drawn the same); the empty string is what an invisible character is drawn as."""
    pairs = [(c, "") for c in invisible()]
    for fixed in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, LATIN, RADICALS):
        pairs += fixed.items()
    pairs += [(c, "-") for c in HYPHENS] + [(c, " ") for c in BLANKS]
    for cp in range(0x80, min(sys.maxunicode, 0x2FFFF) + 1):
        how = unicodedata.decomposition(c := chr(cp))
        if not how or HANGUL[0] <= cp <= HANGUL[1]:
            continue
        if how[0] != "<":
            pairs.append((c, unicodedata.normalize("NFD", c)))
        elif how.startswith(("<wide>", "<narrow>")) or how.startswith("<compat>") and any(a <= cp <= b for a, b in SAME_LOOK):
            pairs.append((c, "".join(chr(int(x, 16)) for x in how.split()[1:])))
    return tuple(pairs)


@cache
def _fold_table() -> dict[int, str]:
    plain = {ord(a): b for a, b in look_alike_pairs() if len(a) == 1 and a != b}
    for cp in list(plain):  # follow chains; a canonical pair may lead on to a fixed one
        while any(ord(c) in plain for c in plain[cp]):
            plain[cp] = "".join(plain.get(ord(c), c) for c in plain[cp])
    return plain


def fold(text: str | None) -> str | None:
    """One fixed form of a short label, so that labels which look the same compare equal. None stays None."""
    return None if text is None else unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_fold_table()))


@cache
def _translation() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    one = {a: b for a, b in ((chr(k), v) for k, v in _fold_table().items()) if len(b) == 1}
    drop = [chr(k) for k, v in _fold_table().items() if v == ""]
    more = tuple((chr(k), v) for k, v in _fold_table().items() if len(v) > 1 and v.isascii())
    return "".join(one) + "".join(drop), "".join(one.values()), more


def fold_column(column: Column) -> Column:
    """fold() inside the JVM, but for letters with accents, which stay as they are."""
    old, new, more = _translation()
    out = F.translate(column, old, new)
    for a, b in more:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
