"""Problem 2: one quantity recorded in different units; every figure becomes a value in its measure's common unit.

Method: the distinct spellings of units in cells, row labels, column headers and captions are mapped to known
units through an inverted index of character n-grams, and the best candidates are verified by a weighted edit
distance (look-alikes cost nothing, blanks, case and a plural's s little, a letter inside a word or a character that
tells no scale one, characters that change the scale more than is ever accepted). Row labels are mapped to glossary
terms by the same index, with less room for edits. The alias dictionaries are joined to all rows.

Defined results: a cell without a number, whose label is no term with a measure, or for which no unit of that
measure is stated, gives no figure; null cells, captions and headers state nothing; a table delivered again
counts once (the latest by parsed_at), tables without an id not at all; of two cells in one place the last counts.
A spelling equally near to two units is none.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.glyphs import fold, fold_column
from inkstone.operators.chunking import latest
from inkstone.session import fence, materialize, small

# Units and how they are written, with their size in the measure's common unit
# (yuan, one, tonne, kilowatt, kilowatt hour, square metre).
UNITS = {
    "money": {1: "元 RMB yuan 人民币 CNY", 1e3: "千元 RMB'000 RMB_thousand RMB_k thousand_yuan", 1e4: "万元", 1e6: "百万元 RMB_million RMB_mn RMB_m RMB_mln million million_yuan", 1e7: "千万元", 1e8: "亿元", 1e9: "十亿元 RMB_billion RMB_bn billion billion_yuan", 1e10: "百亿元"},
    "ratio": {1e-2: "% pct percent per_cent 百分之一 个百分点 percentage_points", 1e-3: "‰ 千分之一", 1e-4: "bp bps basis_points 基点"},
    "mass": {1e-3: "千克 kg 公斤 kilograms", 1: "吨 t tonnes tons metric_tons", 1e3: "千吨 kt", 1e4: "万吨", 1e6: "百万吨 Mt", 1e8: "亿吨"},
    "power": {1: "千瓦 kW kw kilowatts", 1e3: "兆瓦 MW mw megawatts", 1e4: "万千瓦", 1e6: "吉瓦 GW gw 百万千瓦 gigawatts", 1e8: "亿千瓦"},
    "energy": {1: "千瓦时 kWh kwh 度 kilowatt_hours", 1e3: "兆瓦时 MWh mwh megawatt_hours", 1e4: "万千瓦时", 1e6: "吉瓦时 GWh gwh 百万千瓦时 gigawatt_hours", 1e8: "亿千瓦时", 1e9: "TWh twh 太瓦时 terawatt_hours"},
    "area": {1: "平方米 m² m2 sqm 平米 ㎡ square_metres square_meters", 1e4: "万平方米 公顷 ha hectares", 1e6: "平方公里 km² km2 平方千米 百万平方米 square_kilometres square_kilometers"},
}
# Traditional characters of table labels and their simplified forms.
SIMPLIFIED = str.maketrans("業務總額產資負債費淨歸銷財發動現營運貨幣應收賬帳款儲備幹達績險報長貸間稅權東預測師級計劃價設開製錄與單噸電裝機風導體氣鋰鹽飼離發網綠產圍積儲轉廠區礦銀連鎖藥醫療華國際潤項數據億萬", "业务总额产资负债费净归销财发动现营运货币应收账账款储备干达绩险报长贷间税权东预测师级计划价设开制录与单吨电装机风导体气锂盐饲离发网绿产围积储转厂区矿银连锁药医疗华国际润项数据亿万")
#: Characters that change a unit's size or kind: an edit of one is never accepted, unless it stands inside a longer word.
SCALE = set("十百千万亿兆吉太kKmMgGtTbB0123456789元吨瓦时平方米公里顷亩克%‰pPhH²")
LONG_WORD = re.compile(r"[A-Za-z]{5,}")
FILLER = re.compile(r"单位|人民币(?=\S)|另有注明除外|除.{0,6}注明.*|unless (?:otherwise )?stated|in(?= RMB)|为|units?(?=:)|[:()\[\],，、]", re.I)
DICTIONARY_BROADCAST = 100_000
NUMBER = r"^\s*(\()?\s*([-+])?\s*(RMB|CNY|¥)?\s*([-+])?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)\s*(\))?\s*([^\d]*(?:'?000)?[²2]?)\s*[*†]*\s*$"


def edit_costs(s: str) -> list[float]:
    """What dropping or adding each character costs: 0.1 a blank or mark, 0.3 a plural's s, 3 a character that tells the scale, else 1."""
    out = [0.1 if not c.isalnum() and c not in SCALE else 3.0 if c in SCALE else 1.0 for c in s]
    for word in LONG_WORD.finditer(s):  # of a long word the first letter tells the scale
        out[word.start() + 1 : word.end()] = [1.0] * (word.end() - word.start() - 1)
    for k, c in enumerate(s):
        if c == "s" and k > 1 and s[k - 1].isalpha() and not s[k + 1 : k + 2].isalpha():
            out[k] = 0.3
    return out


def weighted_distance(a: str, b: str, most: float = 3.0) -> float:
    """Edit distance by edit_costs; a change costs the dearer of the two, of case only 0.15."""
    costs, own = edit_costs(b), edit_costs(a)
    row = [0.0, *itertools.accumulate(costs)]
    for x, dear in zip(a, own):
        new = [row[0] + dear]
        for k, y in enumerate(b):
            swap = 0.0 if x == y else 0.15 if x.casefold() == y.casefold() else max(dear, costs[k])
            new.append(min(row[k] + swap, row[k + 1] + dear, new[-1] + costs[k]))
        if min(new) > most:
            return min(new)
        row = new
    return row[-1]


class SpellingIndex:
    """Known spellings by their character n-grams (one and two characters), with a value each."""

    def __init__(self, known: dict[str, object]) -> None:
        self.known = known
        self.grams: dict[str, set[str]] = defaultdict(set)
        for spelling in known:
            for g in self._of(spelling):
                self.grams[g].add(spelling)

    @staticmethod
    def _of(s: str) -> set[str]:
        s = s.casefold().replace(" ", "")
        return {*s, *(s[k : k + 2] for k in range(len(s) - 1))}

    def nearest(self, spelling: str, share: float = 0.25, floor: float = 0.5) -> object | None:
        """The value of the nearest known spelling within max(floor, share of its length), if it is the only one so near."""
        if spelling in self.known:
            return self.known[spelling]
        own = self._of(spelling)
        shared: dict[str, int] = defaultdict(int)
        for g in own:
            for s in self.grams.get(g, ()):
                shared[s] += 1
        best: list[tuple[float, object]] = []
        for s, n in shared.items():
            if 2 * n >= len(self._of(s)) and (d := weighted_distance(spelling, s)) <= max(floor, share * len(s)):
                best.append((d, self.known[s]))
        if not best:
            return None
        least = min(d for d, _ in best)
        values = {v for d, v in best if d <= least + 1e-9}
        return values.pop() if len(values) == 1 else None


def unit_index() -> SpellingIndex:
    return SpellingIndex({fold(s.replace("_", " ")): (measure, float(size)) for measure, sizes in UNITS.items() for size, names in sizes.items() for s in names.split()})


def read_unit(spelling: str | None, index: SpellingIndex) -> tuple[str, float] | None:
    """The (measure, size) a spelling states, apart from words around it."""
    if not spelling:
        return None
    text = fold(spelling).strip()
    bare = re.sub(r"\s+", " ", FILLER.sub(" ", text)).strip(" -–:.")
    if not bare and "人民币" in text:
        bare = "人民币"
    return index.nearest(bare) if bare else None


#: Where a unit noted after a label may begin.
NOTED = re.compile(r"\s*[(\[,，、:/]|\s*单位")
#: The share of a label's length that may be edited.
LABEL_SHARE = 0.12


def read_label(label: str | None, terms: SpellingIndex, units: SpellingIndex) -> tuple[int, str, tuple[str, float] | None] | None:
    """The (term_id, measure, unit) of a row label: a term, perhaps with a unit noted after it."""
    if not label:
        return None
    text = fold(label).strip().translate(SIMPLIFIED)
    parts = [(text, None)]
    for m in reversed(list(NOTED.finditer(text))):
        if m.start() and (unit := read_unit(text[m.start() :], units)):
            parts.append((text[: m.start()].strip(), unit))
    for head, unit in parts:  # as it is, before anything that is only near
        if found := terms.known.get(head) or terms.known.get(head.casefold()):
            return (*found, unit)
    for head, unit in parts:
        if found := terms.nearest(head.casefold(), LABEL_SHARE):
            return (*found, unit)
    return None


def term_index(terms: list) -> SpellingIndex:
    known: dict[str, tuple[int, str]] = {}
    for r in sorted(terms, key=lambda r: r.term_id):
        plain = fold(r.term).strip().translate(SIMPLIFIED)
        for s in (plain, plain.casefold()):
            known.setdefault(s, (r.term_id, r.measure))
    return SpellingIndex(known)


def table_rows(tables: DataFrame) -> DataFrame:
    """(table_id, doc_id, page, heads, corner_unit, caption_unit, row, label, cells) of each body row.

    What headers and captions say is read once per table. heads: column -> (year, unit) where the header has a year.
    """
    folded = lambda c: F.trim(fold_column(c))
    once = latest(tables.where("table_id is not null").select("table_id", "doc_id", "page", "caption", "cells", "parsed_at"), ["table_id"], "parsed_at")
    cells = F.array_sort(F.transform(F.filter("cells", lambda c: c.row.isNotNull() & c.col.isNotNull()), lambda c, k: F.struct(c.row.alias("row"), c.col.alias("col"), k.alias("k"), c.text.alias("text"))))
    once = fence(once.select("table_id", "doc_id", "page", "caption", cells.alias("all")))
    place = lambda c: F.struct(c.row, c.col)
    once = fence(once.withColumn("all", F.filter("all", lambda c, k: ~F.coalesce(place(F.get("all", k + 1)) == place(c), F.lit(False)))))
    starts = F.when(F.size("all") > 0, F.filter(F.sequence(F.lit(1), F.size("all")), lambda k: (k == 1) | (F.get("all", k - 2).row != F.get("all", k - 1).row)))
    heads = F.transform(F.filter("all", lambda c: (c.row == 0) & c.text.isNotNull()), lambda c: F.struct(c.col.alias("col"), folded(c.text).alias("text")))
    once = fence(once.select("table_id", "doc_id", "page", "all", starts.alias("starts"), heads.alias("heads"), folded(F.col("caption")).alias("caption")))
    corner = F.try_element_at(F.filter("heads", lambda h: h.col == 0), F.lit(1)).text
    year = lambda t: F.regexp_extract(t, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    dated = F.transform(F.filter("heads", lambda h: F.length(year(h.text)) > 0), lambda h: F.struct(h.col, F.struct(year(h.text).cast("int").alias("year"), _stated(h.text).alias("unit"))))
    rows = F.transform("starts", lambda at, k: F.slice("all", at, F.coalesce(F.get("starts", k + 1), F.size("all") + 1) - at))
    once = fence(once.select("table_id", "doc_id", "page", F.map_from_entries(dated).alias("heads"), corner.alias("corner"), _stated(F.col("caption")).alias("caption_unit"), rows.alias("rows")))
    once = once.where(F.size("heads") > 0).select("table_id", "doc_id", "page", "heads", F.coalesce(_stated(F.col("corner")), F.when(F.col("corner").rlike("单位|元$|RMB"), F.col("corner"))).alias("corner_unit"), "caption_unit", F.explode("rows").alias("cells"))
    first = F.col("cells")[0]
    return once.where((first.row > 0) & (first.col == 0)).select("table_id", "doc_id", "page", "heads", "corner_unit", "caption_unit", first.row.alias("row"), first.text.alias("label"), "cells")


def _stated(column: Column) -> Column:
    """What a header or caption may state: the last bracket's content, what follows a word for unit, or what follows the last comma."""
    bracket = F.regexp_extract(column, r"\(([^()]*)\)\s*$", 1)
    word = F.regexp_extract(column, r"单位\s*[:为]\s*([^,()]*)\)?\s*$", 1)
    comma = F.regexp_extract(column, r"[,，]\s*([^,，()]*)$", 1)
    pick = F.when(F.length(word) > 0, word).when(F.length(bracket) > 0, bracket).when(F.length(comma) > 0, comma)
    return F.when(F.length(F.trim(pick)) > 0, F.trim(pick))


def parsed(rows: DataFrame) -> DataFrame:
    """Body cells that hold a number under a year, with the spellings that may state its unit; columns of rows are kept."""
    kept = [c for c in rows.columns if c not in ("cells", "heads")]
    each = rows.select(*kept, "heads", F.explode(F.filter("cells", lambda c: (c.col > 0) & c.text.isNotNull())).alias("c"))
    each = each.select(*kept, F.element_at("heads", F.col("c.col")).alias("head"), F.col("c.col").alias("col"), F.col("c.text").alias("raw")).where("head is not null")
    each = fence(each.withColumn("text", F.trim(F.when(F.col("raw").rlike(r"[^\x20-\x7e]"), fold_column(F.col("raw"))).otherwise(F.col("raw")))).drop("raw"))
    apart = F.split(F.regexp_replace("text", NUMBER, "\x01".join(f"${k}" for k in range(1, 8))), "\x01")  # one run of the pattern for all of its parts
    each = fence(each.withColumn("parts", apart)).where("size(parts) = 7")
    part = lambda k: F.col("parts")[k - 1]
    minus = (part(2) == "-") | (part(4) == "-") | ((part(1) == "(") & (part(6) == ")"))
    value = F.replace(part(5), F.lit(","), F.lit("")).try_cast("double")
    unit = F.trim(F.concat_ws(" ", F.nullif(part(3), F.lit("")), F.nullif(F.trim(part(7)), F.lit(""))))
    out = each.select(*kept, "col", F.col("head.year").alias("year"), F.when(minus, -value).otherwise(value).alias("number"), F.when(F.length(unit) > 0, unit).alias("cell_unit"), F.col("head.unit").alias("header_unit"))
    return out.where("number is not null")


def _mapped(spellings: DataFrame, schema: str, read) -> DataFrame:
    """A dictionary of distinct spellings, each read in Python once."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = read()
        for batch in batches:
            rows = [(s, *v) for s in batch.column(0).to_pylist() if (v := reader(s)) is not None]
            if rows:
                kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t.split()[1]]) for c, t in zip(zip(*rows), schema.split(", "))], names)

    return materialize(spellings.mapInArrow(run, schema))


def unit_dictionary(cells: DataFrame) -> DataFrame:
    """(spelling, unit_measure, size) of every spelling that states a unit."""
    spelled = cells.select(F.explode(F.array("cell_unit", "header_unit", "corner_unit", "caption_unit")).alias("spelling")).where("spelling is not null").distinct()

    def units():
        index = unit_index()
        return lambda s: read_unit(s, index)

    return _mapped(spelled, "spelling string, unit_measure string, size double", units)


def label_dictionary(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(label, term_id, measure, label_measure, label_size) of every row label that is a term with a measure."""
    given = terms.where("term_id is not null and term is not null and measure is not null").select("term_id", "term", "measure").collect()  # a fixed list

    def read():
        units, known = unit_index(), term_index(given)

        def one(s):
            found = read_label(s, known, units)
            return None if found is None else (found[0], found[1], *(found[2] or (None, None)))

        return one

    return _mapped(labels.where("label is not null").distinct(), "label string, term_id bigint, measure string, label_measure string, label_size double", read)


def figures(tables: DataFrame, terms: DataFrame) -> DataFrame:
    """Every figure of a measured term in the common unit: (doc_id, page, table_id, cell_id, term_id, measure, year, number, value)."""
    side = F.filter("cells", lambda c: (c.col == 0) & (c.row > 0) & c.text.isNotNull())
    labels = label_dictionary(tables.select(F.explode(F.transform(side, lambda c: c.text)).alias("label")), terms)
    cells = materialize(parsed(table_rows(tables).join(small(labels, DICTIONARY_BROADCAST), "label").drop("label")))  # read for the dictionary of units and the join
    units, out = small(unit_dictionary(cells), DICTIONARY_BROADCAST), cells
    for place in ("cell", "header", "corner", "caption"):
        out = out.join(units.select(F.col("spelling").alias(f"{place}_unit"), F.col("unit_measure").alias(f"{place}_measure"), F.col("size").alias(f"{place}_size")), f"{place}_unit", "left")
    plain = F.col("cell_unit").isNull() | F.col("cell_measure").isNotNull()  # something else after the number: no plain figure
    stated = lambda p: F.when(F.col(f"{p}_measure") == F.col("measure"), F.col(f"{p}_size"))
    money = F.when(F.col("measure") == "money", F.coalesce(stated("corner"), stated("caption")))
    size = F.coalesce(stated("cell"), F.when(F.col("cell_measure").isNull(), F.coalesce(stated("label"), stated("header"), money)))
    cell_id = F.concat("table_id", F.lit("-r"), F.col("row").cast("string"), F.lit("c"), F.col("col").cast("string"))
    out = out.where(plain).withColumn("value", F.col("number") * size).where("value is not null").withColumn("cell_id", cell_id)
    return out.select("doc_id", "page", "table_id", "cell_id", "term_id", "measure", "year", "number", "value")


def contradictions(values: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Pairs of figures of one term and year in two tables of a page that differ by more than the tolerance."""
    side = lambda k: values.select("doc_id", "page", "term_id", "year", F.col("table_id").alias(f"table_{k}"), F.col("cell_id").alias(f"cell_{k}"), F.col("value").alias(f"value_{k}"))
    pairs = side("a").join(side("b"), ["doc_id", "page", "term_id", "year"]).where((F.col("table_a") != F.col("table_b")) & (F.col("cell_a") < F.col("cell_b")))
    apart = F.abs(F.col("value_a") - F.col("value_b")) > tolerance * F.greatest(F.abs("value_a"), F.abs("value_b"))
    return pairs.where(apart).select("cell_a", "cell_b").distinct()
