"""Column builders on identifiers of a matrix, its shape, file names and cell type labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import ladder

# Kinds of gene identifier and their patterns, in order of precedence.
ID_TYPES = (
    ("ensembl_rat", r"^ENSRNO[GT]\d{11}$"),
    ("ensembl_mouse", r"^ENSMUS[GT]\d{11}$"),
    ("ensembl_human", r"^ENSG\d{11}$"),
    ("refseq_mrna", r"^[NX]M_\d+"),
    ("refseq_ncrna", r"^[NX]R_\d+"),
    ("entrez", r"^\d{1,9}$"),
    ("mirna_rat", r"^rno-(?:mir|miR|let)-"),
    ("mirna_mouse", r"^mmu-(?:mir|miR|let)-"),
    ("mirna_human", r"^hsa-(?:mir|miR|let)-"),
    ("circrna", r"^(?:circ|circRNA)[_-]?\w+"),
    ("circrna_coords", r"^chr\d+:\d+[\|\-]\d+"),
    ("lncrna", r"^(?:LINC|LOC|lncRNA)\d+"),
    ("lncrna_rat", r"^NONRAT\d+"),
    ("probe_affy", r"^\d+_(?:at|s_at|x_at|a_at)$"),
    ("probe_illumina", r"^ILMN_\d+$"),
)

# Classes of a single identifier and their patterns, in order of precedence.
ID_CLASSES = (
    ("gene:ensembl_rat", r"^ENSRNO[GT]\d{11}$"),
    ("gene:ensembl_mouse", r"^ENSMUS[GT]\d{11}$"),
    ("gene:ensembl", r"^ENS[A-Z]{0,4}[GT]\d{11}$"),
    ("gene:refseq", r"^[NX][MR]_\d+"),
    ("gene:ncbi_loc", r"^LOC\d+$"),
    ("gene:gene_symbol_mouse", r"^[A-Z][a-z0-9]{1,10}$"),
    ("gene:gene_symbol_human", r"^[A-Z][A-Z0-9]{1,10}$"),
    ("gene:mirna_rat", r"^rno-(?:mir|miR|let)-"),
    ("gene:mirna_mouse", r"^mmu-(?:mir|miR|let)-"),
    ("gene:mirna_human", r"^hsa-(?:mir|miR|let)-"),
    ("gene:mirna_generic", r"^(?:mir|miR|let)-\d+"),
    ("gene:circrna", r"^(?:circ|circRNA)[_-]?\w+"),
    ("gene:circrna_coords", r"^chr\d+:\d+[\|\-]\d+"),
    ("gene:lncrna", r"^(?:LINC|LOC|lncRNA)\d+"),
    ("gene:lncrna_rat", r"^NONRAT\d+"),
    ("gene:probe_affy", r"^\d+_(?:at|s_at|x_at|a_at)$"),
    ("gene:probe_illumina", r"^ILMN_\d+$"),
    ("gene:probe_agilent", r"^A_\d+_P\d+$"),
    ("cell:barcode_10x", r"^[ACGT]{16}-\d+$"),
    ("cell:barcode_nucleotide", r"^[ACGT]{8,20}$"),
    ("cell:barcode_with_suffix", r"^[ACGT]{8,20}-\d+$"),
    ("sample:geo_sample", r"^GSM\d{6,9}$"),
    ("sample:sra_run", r"^SRR\d{6,10}$"),
    ("sample:sra_experiment", r"^SRX\d{6,10}$"),
    ("sample:biosample", r"^SAMN\d+$"),
)

# What each kind of identifier measures.
MODALITIES = {
    "mirna": ("mirna_rat", "mirna_mouse", "mirna_human", "mirna_generic"),
    "circrna": ("circrna", "circrna_coords"),
    "lncrna": ("lncrna", "lncrna_rat"),
    "microarray": ("probe_affy", "probe_illumina", "probe_agilent"),
    "mrna": ("ensembl_rat", "ensembl_mouse", "ensembl_human", "ensembl", "refseq", "refseq_mrna", "refseq_ncrna", "ncbi_loc", "gene_symbol_mouse", "gene_symbol_human", "gene_symbol", "entrez"),
}

# Parts of a lower-case file name that tell the tissue, sex and condition, in order of precedence.
FILE_TISSUES = (
    ("aorta", "aorta"), ("heart", "heart"), ("liver", "liver"), ("kidney", "kidney"), ("lung", "lung"), ("brain", "brain"), ("cortex", "cortex"), ("hippocampus", "hippocampus"), ("hypothalamus", "hypothalamus"), ("muscle", "skeletal_muscle"),
    ("gastrocnemius", "gastrocnemius"), ("vastus", "vastus lateralis"), ("bat", "BAT"), ("wat", "WAT-SC"), ("adipose", "adipose"), ("spleen", "spleen"), ("colon", "colon"), ("intestine", "small intestine"), ("blood", "blood RNA"),
    ("adrenal", "adrenal"), ("ovary", "ovary"), ("testis", "testis"), ("skin", "skin"), ("bone", "bone marrow"), ("bm", "bone marrow"), ("retina", "retina"), ("pancreas", "pancreas"),
)
FILE_SEXES = (("-m-", "male"), ("-f-", "female"), ("_m_", "male"), ("_f_", "female"))
FILE_CONDITIONS = (("-y-", "young"), ("-o-", "old"), ("-cr-", "caloric_restriction"), ("_y_", "young"), ("_o_", "old"), ("_cr_", "caloric_restriction"), ("control", "control"), ("sham", "sham"))

# Parts of a file name that tell its content; a file may have several.
CONTENTS = (
    ("count_matrix", r"counts?[_\.]|raw[_\.]?counts?|umi|expression|matrix"),
    ("normalized", r"norm|tpm|fpkm|rpkm|cpm"),
    ("metadata", r"meta|sample[_\.]?info|annotation|phenotype|clinical"),
    ("processed", r"processed|filtered|qc|clustered"),
)


def id_class(raw: Column) -> Column:
    """Class of one identifier (gene, cell or sample, with its kind); null, blank and other ones are unknown."""
    own = F.trim(raw)
    return ladder([(own.rlike(p), F.lit(name)) for name, p in ID_CLASSES], F.lit("unknown"))


def id_type(ids: Column) -> Column:
    """Kind of a list of gene identifiers: that of the first of ten with a known pattern, else symbols by the first five.

    Null and empty lists are unknown; empty strings among the first five do not speak against symbols.
    """
    kinds = F.transform(F.slice(ids, 1, 10), lambda x: ladder([(x.rlike(p), F.lit(name)) for name, p in ID_TYPES]))
    symbols = F.forall(F.slice(ids, 1, 5), lambda x: F.coalesce(x, F.lit("")).rlike(r"^([A-Za-z][A-Za-z0-9\-]{0,20})?$"))
    return F.coalesce(F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0)), F.when((F.size(ids) > 0) & symbols, "gene_symbol"), F.lit("unknown"))


def modality(kind: Column) -> Column:
    """What a kind of identifier measures, with or without its class before a colon."""
    own = F.regexp_replace(kind, "gene:|cell:|sample:", "")
    return ladder([(own.isin(*kinds), F.lit(name)) for name, kinds in MODALITIES.items()], F.lit("unknown"))


def orientation(row_type: Column, row_share: Column, col_type: Column, col_share: Column, rows: Column, cols: Column) -> Column:
    """row_type, col_type, n_genes, n_cells, n_samples and confidence of a matrix from the votes of its names.

    A side's vote counts at a share of 0.6 (high from 0.8). With no vote the side of 15,000 to 40,000 entries, if only one
    is, holds genes, and the other cells if it is longer than 500, else samples.
    """
    told = lambda kind, share: F.when((kind != "unknown") & (share >= 0.6), kind)
    level = lambda share: F.when(share >= 0.8, "high").otherwise("medium")
    r, c = told(row_type, row_share), told(col_type, col_share)
    long_r, long_c = rows.between(15_000, 40_000), cols.between(15_000, 40_000)
    none = r.isNull() & c.isNull()
    other = lambda n: F.when(n > 500, "cells").otherwise("samples")
    rt = ladder([(~none, F.coalesce(r, F.lit("unknown"))), (long_r & ~long_c, F.lit("genes")), (long_c & ~long_r, other(rows))], F.lit("unknown"))
    ct = ladder([(~none, F.coalesce(c, F.lit("unknown"))), (long_c & ~long_r, F.lit("genes")), (long_r & ~long_c, other(cols))], F.lit("unknown"))
    size = lambda kind: F.when(rt == kind, rows).when(ct == kind, cols)
    sure = F.when(r.isNotNull(), level(row_share)).when(c.isNotNull(), level(col_share)).otherwise("low")
    return F.struct(rt.alias("row_type"), ct.alias("col_type"), size("genes").alias("n_genes"), size("cells").alias("n_cells"), size("samples").alias("n_samples"), sure.alias("confidence"))


def file_fields(name: Column) -> Column:
    """tissue, sex and condition that the last part of a path tells, each by the first part that occurs in it."""
    low = F.lower(F.substring_index(name, "/", -1))
    first = lambda parts: ladder((low.contains(p), F.lit(v)) for p, v in parts)
    return F.struct(first(FILE_TISSUES).alias("tissue"), first(FILE_SEXES).alias("sex"), first(FILE_CONDITIONS).alias("condition"))


def file_contents(name: Column) -> Column:
    """Sorted list of what a file name tells of its content; unknown if nothing."""
    tags = F.filter(F.array(*[F.when(F.lower(name).rlike(p), tag) for tag, p in CONTENTS]), lambda t: t.isNotNull())
    return F.when(F.size(tags) > 0, F.array_sort(tags)).otherwise(F.array(F.lit("unknown")))


def file_decision(name: Column, in_archive: Column, skip: tuple[str, ...], target: tuple[str, ...], selective: bool = True, discovery: bool = False) -> Column:
    """action and pattern for a file: skipped by name, taken whole, in a wanted archive, of a target pattern, or no match.

    Patterns ignore case; the first that matches is told.
    """
    matched = lambda patterns: ladder([(name.rlike("(?i)" + p), F.lit(p)) for p in patterns]) if patterns else F.lit(None).cast("string")
    skipped, wanted = matched(skip), matched(target)
    everything = F.lit(discovery or not selective)
    take = everything | F.coalesce(in_archive, F.lit(False)) | wanted.isNotNull()
    action = ladder([(skipped.isNotNull(), F.lit("skip_pattern")), (take, F.lit("download"))], F.lit("skip_no_match"))
    by_target = ~everything & ~F.coalesce(in_archive, F.lit(False))
    return F.struct(action.alias("action"), F.coalesce(skipped, F.when(by_target, wanted)).alias("pattern"))


def coarse_label(label: Column, scheme: str | None = None) -> Column:
    """Cell type label by the coarser scheme of brain, muscle or lung; other labels, and all without a scheme, stay."""
    low = F.lower(F.trim(label))
    has = lambda *parts: low.rlike("|".join(parts))
    # The labels that each scheme joins.
    schemes = {
        "brain": [
            (has("pyramidal", "glutamat", "glutamin", "vglut", "principal") | low.isin("neurons", "cortical neurons", "mature neurons", "hippocampal neurons"), "Excitatory neurons"),
            (low.isin("microglia", "microglial cells"), "Microglia"),
            (has("oligodendrocyte precursor", "oligodendrocyte progenitor"), "Oligodendrocyte precursor cells"),
        ],
        "muscle": [(has("skeletal muscle") | low.isin("myofibers", "muscle fibers"), "Skeletal muscle")],
        "lung": [
            (low.isin("clara cells", "club cells", "airway club cells"), "Club cells"),
            (has("ciliated"), "Ciliated cells"),
            (low.isin("natural killer cells", "nk cells"), "NK cells"),
        ],
    }
    if scheme in (None, "none"):
        return label
    if scheme not in schemes:
        raise ValueError(f"no scheme {scheme}: one of {sorted(schemes)}")
    return ladder([(test, F.lit(name)) for test, name in schemes[scheme]], label)


def label_words(label: Column) -> Column:
    """Distinct lower-case words of a label without those that tell nothing; words over three letters lose their s."""
    words = F.filter(F.split(F.lower(label), "[^a-z0-9]+"), lambda w: ~w.isin("", "hepatic", "cell", "cells"))
    return F.array_distinct(F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.substring(w, 1, F.length(w) - 1)).otherwise(w)))
