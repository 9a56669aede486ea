"""Column builders for gene identifiers, biotypes and labels. All are plain Spark SQL expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns and their namespaces, in order of precedence, matched without regard to case.
NAMESPACES = (
    (r"^ENSRNOG\d{11}$", "ensembl_rat"),
    (r"^ENSG\d{11}$", "ensembl_human"),
    (r"^ENSMUSG\d{11}$", "ensembl_mouse"),
    (r"^RGD\d+$", "rgd"),
    (r"^(NM_|NR_|XM_|XR_)\d+", "refseq"),
    (r"^LOC\d+$", "loc"),
    (r"^RF\d{5}$", "rfam"),
    (r"^AABR\d+", "contig"),
    (r"^JACYVU\d+", "contig"),
    (r"^MU\d{6}$", "contig"),
    (r"^AC\d{6}", "contig"),
    (r"^CM\d{6}", "contig"),
    (r"^CHR\d+[_:]\d+", "genomic_coord"),
    (r"^\d{7,}_AT$", "probe"),
)

# Patterns of names that are no genes, in order of precedence.
NON_GENES = (
    (r"^AABR\d+", "aabr_contig"),
    (r"^JACYVU\d+", "jacyvu_scaffold"),
    (r"^MU\d{6}$", "mu_contig"),
    (r"^AC\d{6}", "ac_contig"),
    (r"^CM\d{6}", "cm_contig"),
    (r"^RF\d{5}$", "rfam"),
    (r"^\d{7,}_AT$", "probe_id"),
    (r"^CHR\d+[_:]\d+", "genomic_coord"),
    (r"^U\d+$", "small_rna"),
    (r"^7SK$", "small_rna"),
)

# Names that the resolution of matrix rows turns away. (pattern, without regard to case)
REJECTED = (
    (r"^\d+$", False),
    (r"^(\d+|[XYM]):(\d+)-(\d+)$", False),
    (r"^chr", True),
    (r"^RF\d{5}$", False),
    (r"^[A-Z]{2}\d{6,8}$", False),
    (r"^JACYVU\d+$", False),
    (r"^AABR\d+$", False),
    (r"^ENSMUSG", True),
    (r"^ENSG\d", True),
    (r"^\d+_(at|s_at|x_at)$", False),
    (r"^ILMN_\d+$", False),
)

# Names of mitochondrial genes, without regard to case.
MITO = (r"^mt-", r"^ENSRNOG\d+.*mt", r"^Mt_")

# Biotypes that have another spelling in token tables.
BIOTYPE_OUTPUT = {"protein_coding": "protein_coding", "lncrna": "lncRNA", "mirna": "miRNA"}

# Canonical biotypes and the spellings (lower case, underscored) that stand for them.
BIOTYPES = {
    "protein_coding": ("protein_coding", "protein_coding_gene"),
    "mirna": ("mirna", "micro_rna"),
    "lncrna": ("lncrna", "lincrna", "long_noncoding_rna", "processed_transcript", "antisense", "sense_intronic", "sense_overlapping", "3prime_overlapping_ncrna", "bidirectional_promoter_lncrna", "macro_lncrna"),
    "snorna": ("snorna",),
    "snrna": ("snrna",),
    "rrna": ("rrna", "mt_rrna", "mt_trna"),
    "misc_rna": ("misc_rna",),
    "pseudogene": ("pseudo", "pseudogene", "processed_pseudogene", "unprocessed_pseudogene", "transcribed_processed_pseudogene", "transcribed_unprocessed_pseudogene", "translated_processed_pseudogene", "polymorphic_pseudogene"),
    "ncrna": ("ncrna",),
    "gene": ("gene",),
    "tec": ("tec",),
    "ig_gene": ("ig_c_gene", "ig_d_gene", "ig_j_gene", "ig_v_gene"),
    "tr_gene": ("tr_c_gene", "tr_d_gene", "tr_j_gene", "tr_v_gene"),
}


def ladder(pairs, otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds; null (or otherwise) if none does."""
    out = reduce(lambda acc, p: acc.when(p[0], p[1]), list(pairs), F)
    return out if otherwise is None else out.otherwise(otherwise)


def _stem(raw: Column) -> Column:
    return F.substring_index(F.trim(raw), ".", 1)


def normalize_ensembl(raw: Column) -> Column:
    """Trimmed, upper case, without the version after the first dot."""
    return F.upper(_stem(raw))


def namespace(raw: Column) -> Column:
    """Namespace of an identifier: first pattern that matches, else symbol by shape, else unknown; null stays null."""
    stem = _stem(raw)
    shape = stem.rlike(r"^\p{L}") & F.char_length(stem).between(2, 30)
    known = [(stem.rlike("(?i)" + p), F.lit(v)) for p, v in NAMESPACES]
    return F.when(raw.isNull(), F.lit(None)).otherwise(ladder([*known, (shape, F.lit("symbol"))], F.lit("unknown")))


def non_gene(raw: Column) -> Column:
    """Category of a name that is no gene, else null."""
    return ladder((_stem(raw).rlike("(?i)" + p), F.lit(v)) for p, v in NON_GENES)


def biotype(raw: Column) -> Column:
    """Canonical biotype: known spelling, then what the name contains, then the underscored name itself."""
    key = F.regexp_replace(F.lower(F.trim(raw)), "[- ]", "_")
    known = [(key.isin(*names), F.lit(v)) for v, names in BIOTYPES.items()]
    has = key.contains
    near = [
        (has("protein") & has("coding"), "protein_coding"),
        (has("mirna") | (has("micro") & has("rna")), "mirna"),
        (has("lncrna") | has("lincrna") | (has("long") & has("noncoding")), "lncrna"),
        (has("snorna"), "snorna"),
        (has("snrna"), "snrna"),
        (has("rrna"), "rrna"),
        (has("pseudogene"), "pseudogene"),
    ]
    return ladder([*known, *((c, F.lit(v)) for c, v in near)], key)


# Letters that file names of labels spell out.
SPELLED = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "π": "pi", "σ": "sigma", "τ": "tau", "ω": "omega",
    "ä": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "í": "i", "ñ": "n", "ö": "o", "ü": "u", "Ä": "A", "Ö": "O", "Ü": "U",
}


def file_name(label: Column) -> Column:
    """A label as the stem of a file name: known letters spelled out, then as safe_label, without underscores at its ends."""
    one = {k: v for k, v in SPELLED.items() if len(v) == 1}
    out = F.translate(label, "".join(one), "".join(one.values()))
    for k, v in SPELLED.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(safe_label(out), "^_+|_+$", "")


def safe_label(label: Column) -> Column:
    """File-name form of a label: runs of other than ASCII letters and digits become one underscore."""
    return F.regexp_replace(label, "[^A-Za-z0-9]+", "_")


def symbol_root(symbol: Column) -> Column:
    """Leading letters of a symbol in upper case, if three or more; else empty."""
    return F.upper(F.regexp_extract(symbol, "^([A-Za-z]{3,})", 1))


def kmers(sequence: Column, k: int = 6) -> Column:
    """All overlapping substrings of length k, in order."""
    n = F.char_length(sequence)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(sequence, i, F.lit(k)))
    return F.when(n >= k, every).otherwise(F.array().cast("array<string>"))


def is_species(raw: Column, species: str) -> Column:
    """Whether a normalized identifier is an Ensembl gene of rat, human or mouse."""
    stem = {"rat": "ENSRNOG", "human": "ENSG", "mouse": "ENSMUSG"}[species]
    return normalize_ensembl(raw).rlike(rf"^{stem}\d{{11}}$")


def rejected(name: Column) -> Column:
    """Whether a matrix row's name is none that resolution looks up."""
    return reduce(lambda a, b: a | b, (name.rlike(("(?i)" if fold else "") + p) for p, fold in REJECTED))


def mitochondrial(name: Column) -> Column:
    """Whether an original (not normalized) name is a mitochondrial gene's."""
    return reduce(lambda a, b: a | b, (name.rlike("(?i)" + p) for p in MITO))


def kept_biotype(raw: Column, keep: tuple[str, ...]) -> Column:
    return biotype(raw).isin(*keep)


def output_biotype(canonical: Column) -> Column:
    """A canonical biotype as token tables spell it."""
    return ladder(((canonical == k, F.lit(v)) for k, v in BIOTYPE_OUTPUT.items()), canonical)
