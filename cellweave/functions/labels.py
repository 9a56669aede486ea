"""Column builders for study scores, titles, sizes, labels and value checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import ladder

# Parts of a strain's name that only mouse strains have.
MOUSE_STRAINS = ("c57bl", "balb/c", "balbc", "dba", "fvb", "129s", "nod", "icr", "cd1", "cd-1")

# Bounds of the size bands in MiB.
SIZES = ((1, "<1MB"), (10, "1-10MB"), (100, "10-100MB"), (1024, "100MB-1GB"), (10240, "1-10GB"))

# Barcode counts of whole 10x barcode spaces, and the most barcodes of a filtered matrix.
UNFILTERED, MOST_FILTERED = (6_794_880, 737_280, 2_097_152), 500_000

# Strain spellings, in order of precedence for names that hold one of them.
STRAINS = {
    "sprague dawley": "Sprague-Dawley",
    "sprague-dawley": "Sprague-Dawley",
    "sd": "Sprague-Dawley",
    "wistar": "Wistar",
    "fischer 344": "Fischer 344",
    "fischer344": "Fischer 344",
    "f344": "Fischer 344",
    "lewis": "Lewis",
    "brown norway": "Brown Norway",
    "long-evans": "Long-Evans",
    "long evans": "Long-Evans",
    "not_specified": "not_specified",
    "not specified": "not_specified",
    "unknown": "not_specified",
    "not_applicable": "not_applicable",
    "not applicable": "not_applicable",
    "n/a": "not_applicable",
}

# Spellings of sexes.
SEXES = {
    "male": "male",
    "m": "male",
    "female": "female",
    "f": "female",
    "both": "both",
    "mixed": "mixed",
    "not_specified": "not_specified",
    "not specified": "not_specified",
    "unknown": "not_specified",
    "not_applicable": "not_applicable",
    "not applicable": "not_applicable",
    "not_applicable_cell_line": "not_applicable",
    "n/a": "not_applicable",
}

# Spellings of tissues, and names that keep their case.
TISSUES = {
    "small_intestine": "small intestine",
    "wat-sc": "WAT-SC",
    "wat_sc": "WAT-SC",
    "white adipose": "WAT-SC",
    "bat": "BAT",
    "brown adipose": "BAT",
    "blood rna": "blood RNA",
    "blood_rna": "blood RNA",
}
TISSUES_AS_THEY_ARE = ("WAT-SC", "BAT", "blood RNA")

# Titles of samples that are no single cells of an adult animal, without regard to case.
TITLES = {
    "spatial": r"(visium|_vis\b|\bvis\b|spatial|slide-?seq|geomx|cosmx)",
    "engineered": r"(engineered|cell isolate|tri-?culture|co-?culture|organoid|cultured|\bin[- ]?vitro|ipsc|cell line|passage|\bday ?\d|\bd\d+\b|sorted|cd\d+\+|facs|flow-?sorted|magnetic)",
    "bulk": r"(bulk rna|whole[- ]tissue rna(?!-seq single))",
    "developmental": r"(\bE\d+\.?\d*\b|\bP\d+\b|embryo|embryonic|fetal|foetal|neonat|postnatal)",
}


def _spelled(values: dict[str, str], low: Column) -> list[tuple[Column, Column]]:
    return [(low == k, F.lit(v)) for k, v in values.items()]


def strain_name(raw: Column) -> Column:
    """Strain by its known spelling, else by the first that the name holds, else as it is; none is not_specified."""
    low = F.lower(F.trim(raw))
    held = [(low.contains(k), F.lit(v)) for k, v in STRAINS.items()]
    return F.when(F.coalesce(raw, F.lit("")) == "", "not_specified").otherwise(ladder([*_spelled(STRAINS, low), *held], raw))


def sex_name(raw: Column) -> Column:
    """Sex by its known spelling, else by the words that the description holds ("female" holds "male" too)."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    male, female = low.contains("male"), low.contains("female")
    return ladder([*_spelled(SEXES, low), (male & female, F.lit("mixed")), (male, F.lit("male"))], F.lit("not_specified"))


def tissue_names(raw: Column) -> Column:
    """The tissues of a comma list by their known spellings; others of more than three letters with capitals."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")

    def name(t: Column) -> Column:
        known = ladder(_spelled(TISSUES, t), t)
        return F.when(known.isin(*TISSUES_AS_THEY_ARE) | (F.char_length(known) <= 3), known).otherwise(F.initcap(known))

    return F.transform(parts, name)


def title_check(title: Column) -> Column:
    """fail:kind for spatial, engineered or bulk titles (the first that holds), warn:developmental, unknown or ok."""
    hits = [(title.rlike("(?i)" + TITLES[k]), F.lit(f"fail:{k}")) for k in ("spatial", "engineered", "bulk")]
    return ladder([(F.coalesce(title, F.lit("")) == "", F.lit("warn:unknown")), *hits, (title.rlike("(?i)" + TITLES["developmental"]), F.lit("warn:developmental"))], F.lit("ok"))


def usability_score(processed: Column, counts: Column, metadata: Column, title: Column, summary: Column, samples: Column) -> Column:
    """30 each for processed data and counts, 10 each for metadata, a title, a summary and samples; null counts as no."""
    told = lambda c: F.coalesce(c != "", F.lit(False))
    parts = [(processed, 30), (counts, 30), (metadata, 10), (told(title), 10), (told(summary), 10), (samples > 0, 10)]
    return reduce(lambda a, b: a + b, (F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in parts))


def completeness(*parts: Column) -> Column:
    """Share of the parts that hold, to two places; null counts as no."""
    held = reduce(lambda a, b: a + b, (F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in parts))
    return F.round(held / len(parts), 2)


def mouse_strain(strain: Column) -> Column:
    low = F.lower(F.coalesce(strain, F.lit("")))
    return reduce(lambda a, b: a | b, (low.contains(s) for s in MOUSE_STRAINS))


def size_band(size_bytes: Column) -> Column:
    mb = size_bytes / (1024 * 1024)
    return ladder(((mb < most, F.lit(name)) for most, name in SIZES), F.lit(">10GB"))


def unfiltered_10x(barcodes: Column) -> Column:
    """Whether a matrix has as many columns as a whole barcode space."""
    return barcodes.isin(*UNFILTERED) | (barcodes > MOST_FILTERED)


def fuzzy_match(a: Column, b: Column) -> Column:
    """100 for equal names, 50 + the length of b where one holds the other, else 10 for each shared word."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    within = x.contains(y) | y.contains(x)
    return F.when(y == "", 0).when(x == y, 100).when(within, 50 + F.char_length(y)).otherwise(10 * F.size(F.array_intersect(F.split(x, r"\s+"), F.split(y, r"\s+"))))


def value_kind(whole: Column, least: Column, most: Column) -> Column:
    """What nonzero values of a matrix are: counts, logs, TPM or other, by whether all are whole, their least and most."""
    return ladder([(most.isNull(), F.lit("all_zeros")), (whole, F.lit("counts")), ((most < 20) & (least < 1), F.lit("log")), (most > 1_000_000, F.lit("tpm"))], F.lit("other"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def signed_log_p(p: Column, effect: Column) -> Column:
    """-log10 of a p value with the sign of its effect."""
    return F.signum(effect) * -F.log10(F.greatest(p, F.lit(1e-300)))
