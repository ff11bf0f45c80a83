"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from inkstone.functions.glyphs import look_alike_pairs

BLANK = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def norm(c: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(replace({c}, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def bare(c: str) -> str:
    return rf"regexp_replace({c}, '[{BLANK}]+', '', 'g')"


def number_id(prefix: str, mark: str, n: str) -> str:
    return f"{prefix} || '-{mark}' || CASE WHEN length(({n})::VARCHAR) < 3 THEN lpad(({n})::VARCHAR, 3, '0') ELSE ({n})::VARCHAR END"


def latest(name: str, key: str, at: str) -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC) = 1)"


PAGES = latest("parsed_pages", "doc_id, page", "parsed_at")
TABLES = latest("structured_tables", "table_id", "parsed_at")
BOXES = latest("text_boxes", "box_id", "loaded_at")


def windows(text: str, size: int | str, overlap: int | str) -> str:
    """A list of the non-empty windows of a normalized text."""
    return f"list_filter(list_transform(generate_series(0, greatest(length({text}) - ({overlap}) - 1, 0), ({size}) - ({overlap})), lambda s: {strip(f'substring({text}, (s + 1)::BIGINT, ({size})::BIGINT)')}), lambda p: length(p) > 0)"


def text(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def looks(c: str) -> str:
    """What a text looks like, by fixed representatives: look-alikes replaced, invisible characters gone, marks composed."""
    drop, one, more = [], {}, []
    for a, b in look_alike_pairs():
        if b == "":
            drop.append(a)
        elif len(a) == 1 and len(b) == 1:
            one[a] = b
        elif len(a) == 1 and all(x.isascii() for x in b):
            more.append((a, b))
    for a, b in more:
        c = f"replace({c}, {text(a)}, {text(b)})"
    return f"nfc_normalize(translate({c}, {text(''.join(one) + ''.join(drop))}, {text(''.join(one.values()))}))"
