"""Column expressions that audit labelled pairs of titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Condition tiers from worst to best, with their patterns (fixed values).
TIERS = (
    (4, "PARTS", r"for\s*parts|spares|faulty|broken|not\s*working|damaged|as[\s-]is|defective|dead|cracked\s*screen|water\s*damage|doesn.t\s*work|won.t\s*turn\s*on|needs\s*repair"),
    (3, "FAIR/C", r"grade\s*c|fair\s*condition|average|scratches|scuffs|dents|cosmetic\s*damage|well\s*used|heavily\s*used|worn"),
    (2, "GOOD/B", r"grade\s*b|good\s*condition|very\s*good|great\s*condition|gently\s*used|lightly\s*used|pre[\s-]?owned"),
    (1, "EXCELLENT/A", r"grade\s*a\+?|pristine|mint\s*condition|excellent|like\s*new|near\s*mint|nm\+?|immaculate|flawless"),
    (0, "NEW/SEALED", r"sealed|bnib|brand\s*new|factory\s*sealed|unopened|shrink\s*wrap|new\s*in\s*box|new\s*sealed|mint\s*sealed"),
)
#: Titles of accessories (fixed values).
ACCESSORY = (
    r"replacement\s+(?:cord|cable|charger|battery|strap|band|barrel|brush|filter|blade|nozzle|head|tip|pad|roller)"
    r"|spare\s+(?:battery|charger|cable|strap|band|part|wheel)"
    r"|(?:cord|cable|charger|strap|band|barrel|brush|filter|blade|nozzle)\s+only"
    r"|disc\s*drive\s*(?:only|unit|attachment)"
    r"|power\s*(?:cord|cable|adapter)\s+(?:only|replacement|for\b)"
    r"|(?:just|only)\s+the\s+(?:cord|cable|charger|remote|controller|strap|band|base|dock|stand)"
)
#: Sizes that are memory, not storage, in GB (fixed values).
RAM_SIZES = (4, 8, 12, 16, 18, 24, 32, 36, 48, 64)
LAPTOP = r"laptop|macbook|thinkpad|zenbook|xps|surface|elitebook|spectre|pavilion|inspiron|desktop|pc|workstation"
LOT = r"joblot|job\s*lot|bundle\s*of\s*\d+|lot\s*of\s*\d+"
COLOURS = ("black", "white", "silver", "gold", "red", "blue", "green", "pink", "purple", "grey")


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(rf"(?i)\b(?:{pattern})\b")


def condition_tier(title: Column, description: Column) -> Column:
    """Tier number found first from worst to best in the title and 200 characters of the description, or null."""
    text = F.concat(title, F.lit(" "), F.substring(F.coalesce(description, F.lit("")), 1, 200))
    return reduce(lambda c, t: c.when(_has(text, t[2]), t[0]), TIERS, F.when(F.lit(False), 0))


def accessory_mismatch(a: Column, b: Column) -> Column:
    return _has(a, ACCESSORY) != _has(b, ACCESSORY)


def tier_mismatch(a: Column, b: Column) -> Column:
    """Premium against ultra-premium collections, digital against disc editions, slim against original consoles."""
    ultra, premium = (lambda x: x.rlike(r"(?i)\bultra[\s-]?premium")), (lambda x: _has(x, r"premium\s+collection"))
    digital, disc = (lambda x: _has(x, r"digital\s+edition")), (lambda x: _has(x, r"disc\s+(?:edition|version)"))
    console, slim = (lambda x: _has(x, r"PS5|PlayStation\s*5")), (lambda x: _has(x, "slim"))
    one_ultra = lambda x, y: ultra(x) & ~ultra(y) & premium(y) & ~premium(x)
    return one_ultra(a, b) | one_ultra(b, a) | (digital(a) & disc(b)) | (disc(a) & digital(b)) | (console(a) & console(b) & (slim(a) != slim(b)))


def largest_storage(title: Column) -> Column:
    """Largest storage size in GB (1 TB is 1000), memory sizes aside unless the title says SSD; null if unclear."""
    found = F.regexp_extract_all(title, F.lit(r"(?i)\b\d+\s*(?:GB|TB)\b"), F.lit(0))
    gb = F.transform(found, lambda s: F.regexp_extract(s, r"\d+", 0).cast("bigint") * F.when(s.rlike("(?i)TB"), 1000).otherwise(1))
    kept = F.filter(gb, lambda g: ~g.isin(*RAM_SIZES) | _has(title, "SSD"))
    several = title.rlike(r"(?i)\d+\s*/\s*\d+\s*(?:GB|TB)") | title.rlike(r"(?i)\d+\s*(?:GB|TB)\s*,\s*\d+\s*(?:GB|TB)") | (F.size(found) >= 3)
    return F.when(~several, F.array_max(kept))


def storage_mismatch(a: Column, b: Column) -> Column:
    x, y = largest_storage(a), largest_storage(b)
    return F.coalesce((x != y) & (F.abs(x - y) / F.greatest(x, y) >= 0.15), F.lit(False))


def apple_chip(title: Column) -> Column:
    """M1 to M4 with Pro, Max or Ultra within 25 characters, or null."""
    base = F.upper(F.regexp_extract(title, r"(?i)\b(M[1-4])\b", 1))
    tier = F.initcap(F.regexp_extract(title, r"(?i)\bM[1-4]\b.{0,25}?\b(Pro|Max|Ultra)\b", 1))
    return F.when(base != "", F.concat_ws(" ", base, F.nullif(tier, F.lit(""))))


def chip_mismatch(a: Column, b: Column) -> Column:
    intel = lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"\bi[3579]\b"), F.lit(0))))
    apple = F.coalesce(apple_chip(a) != apple_chip(b), F.lit(False))
    return apple | ((_has(a, LAPTOP) | _has(b, LAPTOP)) & (F.size(intel(a)) > 0) & (F.size(intel(b)) > 0) & (intel(a) != intel(b)))


def is_bundle(title: Column) -> Column:
    """Lots, packs of several and counts before an x; model numbers and connectors aside."""
    count = F.regexp_extract(title, r"(?i)\b(\d+)\s*(?:pack(?!s?\s*-)|pcs|pieces|items|units)\b", 1).try_cast("int")
    times = title.rlike(r"(?i)(?<![a-zA-Z\d])[2-9]\d{0,2}\s*x\s+(?![\d.]+\b)(?!(?:M\.?\d|speed|usb|hdmi|pcie|sata|nvme|ddr|ssd|hdd|gpu|cpu|ram|dimm)\b)")
    return _has(title, LOT) | F.when(count.isNotNull(), count > 1).otherwise(times)


def quantity_mismatch(a: Column, b: Column) -> Column:
    return is_bundle(a) != is_bundle(b)


def colour_mismatch(a: Column, b: Column) -> Column:
    found = lambda x: F.regexp_extract_all(F.lower(x), F.lit(rf"\b(?:{'|'.join(COLOURS)})\b"), F.lit(0))
    return (F.size(found(a)) > 0) & (F.size(found(b)) > 0) & ~F.arrays_overlap(found(a), found(b))


def audit_reasons(title_a: Column, desc_a: Column, title_b: Column, desc_b: Column) -> Column:
    """Names of the rules that say two listings are not comparable, joined by '; '."""
    tier_a, tier_b = condition_tier(title_a, desc_a), condition_tier(title_b, desc_b)
    rules = {
        "condition": F.coalesce(F.abs(tier_a - tier_b) >= 2, F.lit(False)),
        "accessory": accessory_mismatch(title_a, title_b),
        "tier": tier_mismatch(title_a, title_b),
        "storage": storage_mismatch(title_a, title_b),
        "chip": chip_mismatch(title_a, title_b),
        "quantity": quantity_mismatch(title_a, title_b),
    }
    return F.array_join(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items()))), "; ")


#: Typed fields of a title's fingerprint: name, pattern, group (fixed values).
FIELDS = (
    ("storage_gb", r"(?i)\b(\d+)\s*GB\b"),
    ("storage_tb", r"(?i)\b(\d+)\s*TB\b"),
    ("ram", r"(?i)\b(\d+)\s*GB\s+RAM\b"),
    ("screen", r"(?i)\b(\d{1,2}(?:\.\d)?)\s*(?:inch|in|\")"),
    ("chip", r"(?i)\b(M[1-4](?:\s+(?:Pro|Max|Ultra))?)\b"),
    ("cpu", r"(?i)\b(i[3579])\b"),
    ("edition", r"(?i)\b(digital|disc)\s+edition\b"),
    ("volt", r"(?i)\b(\d{2})\s*V\b"),
    ("size_mm", r"(?i)\b(\d{2})\s*mm\b"),
    ("colour", rf"(?i)\b({'|'.join(COLOURS)})\b"),
)


def fingerprint(title: Column) -> Column:
    """Map of the fields found in a title, lower-cased."""
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.nullif(F.lower(F.regexp_extract(title, p, 1)), F.lit("")).alias("value")) for n, p in FIELDS))
    return F.map_from_entries(F.filter(pairs, lambda kv: kv["value"].isNotNull()))


def fingerprint_diff(a: Column, b: Column) -> Column:
    """Fields in both maps with different values; screens may differ by 0.3, and 18 and 20 volts are one."""
    volt = lambda v: F.when(v == "18", "20").otherwise(v)
    differs = lambda k, x, y: F.when(k == "screen", F.abs(x.cast("double") - y.cast("double")) > 0.3 + 1e-9).when(k == "volt", volt(x) != volt(y)).otherwise(x != y)
    return F.filter(F.map_keys(a), lambda k: F.map_contains_key(b, k) & differs(k, a[k], b[k]))
