"""Fixed values.  They decide results, so they are stated plainly and in one place."""

# --- fixed values: cut-offs -------------------------------------------------
CONTEXT_SCORE = 0.7          # score from which an edge belongs to the context graph
CHANNEL_SCORE = 0.15         # score from which channel rows are requested
PARTNERS_PER_SEED = 20
DEGREE_PRODUCT_QUANTILE = 0.90
GATE_PHYSICAL_STOP = 0.90
GATE_UNREPORTED_RUN = 0.15
GATE_SPEARMAN_RUN = 0.30
MAX_RESIDUES = 1022
FASTA_WIDTH = 60
HIT_LIST_ROWS = 50
TOP_PER_GROUP = 15
BENCHMARK_SEEDS = 20
MIN_POSITIVES = 12
MIN_TEST_POSITIVES = 2
LOG_DEGREE_TOLERANCE = 0.35
EDGE_RATIOS = (0.8, 0.1, 0.1)
NODE_RATIOS = (0.7, 0.15, 0.15)
PRECISION_KS = (10, 20, 50)
LOGIT_CLIP = 30.0

# --- fixed values: roles ----------------------------------------------------
ROLE_A, ROLE_B, ROLE_BOTH, ROLE_PARTNER = "a", "b", "both", "partner"
A_LIKE = (ROLE_A, ROLE_BOTH)
B_LIKE = (ROLE_B, ROLE_BOTH)

# --- fixed values: score channels and their labels ---------------------------
CHANNELS = ("nscore", "fscore", "pscore", "ascore", "escore", "dscore", "tscore")
CHANNEL_LABELS = {
    "nscore": "neighborhood",
    "fscore": "fusion",
    "pscore": "cooccurrence",
    "ascore": "coexpression",
    "escore": "experiments",
    "dscore": "databases",
    "tscore": "textmining",
}

# --- fixed values: location keywords -----------------------------------------
LOCATION_KEYWORDS = {
    "nucleus": ["nucleus", "nucleoplasm", "nucleolus", "nuclear speckle"],
    "cytoplasm": ["cytoplasm", "cytosol", "cytoplasmic"],
    "cortex": ["cell cortex", "plasma membrane", "cell membrane", "cell periphery", "bud neck",
               "site of polarized growth", "cell septum"],
    "cytoskeleton": ["cytoskeleton", "actin filament", "actin cytoskeleton", "microfilament"],
    "extracellular": ["extracellular", "secreted", "cell wall", "external side"],
    "mitochondrion": ["mitochondrion", "mitochondrial"],
}
EXCLUSIVE_LOCATIONS = ("extracellular", "nucleus", "mitochondrion")

# --- fixed values: direct (tier-1) assay names and method-ontology ids -------
TIER1_ASSAYS = (
    "Two-hybrid", "Two-hybrid Array", "Two-hybrid Pooling", "Reconstituted Complex", "PCA", "FRET",
    "BiFC", "Far Western", "Protein-peptide", "Co-crystal Structure", "Biochemical Activity",
)
TIER1_METHODS = (
    "MI:0018", "MI:0019", "MI:0397", "MI:0398", "MI:0399", "MI:0096", "MI:0412", "MI:0055",
    "MI:0809", "MI:0114", "MI:0107", "MI:0047", "MI:0407", "MI:0408",
)

# --- fixed values: taxa -------------------------------------------------------
ALLOWED_TAXA = (9606, 4932, 559292)
TAXON_ALIASES = {559292: 4932}   # strain id used by sequence and catalog files -> id used by edges

# --- fixed values: seed symbols per group -------------------------------------
SEED_SYMBOLS = {
    9606: {
        "a": ["YAP1", "WWTR1", "LATS1", "LATS2", "STK3", "STK4", "SAV1", "MOB1A", "NF2", "TEAD1"],
        "b": ["ACTB", "CFL1", "PFN1", "GSN", "DIAPH1", "ACTN1", "VCL", "RHOA", "CDC42", "RAC1"],
    },
    4932: {
        "a": ["CBK1", "KIC1", "MOB2", "TAO3", "SOG2", "HYM1"],
        "b": ["ACT1", "COF1", "PFY1", "BNI1", "BNR1", "CDC42", "RHO1", "SAC6", "TPM1", "ABP1"],
    },
}

# --- fixed values: identifier patterns ----------------------------------------
ACCESSION = r"[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2}"
PREFIXED_ACCESSION = r"(?i)(?:uniprotkb|uniprot|uniprot\.isoform):([A-Z0-9\-]+)"
PUBLICATION_ID = r"(?i)(?:pubmed:|PMID:)?(\d{4,9})"
METHOD_ID = r"MI:\d{4}"
TAXON_ID = r"(?i)taxid:(\d+)"

# --- fixed values: evidence classes --------------------------------------------
CLASS_PHYSICAL = "physical_curated"
CLASS_ARTIFACT = "artifact_risk"
CLASS_FUNCTIONAL = "string_functional_only"
CLASS_UNREPORTED = "unreported"

# --- fixed values: headers of landed files ---
CHANNEL_HEADERS = {
    "src": ("stringId_A", "src"), "dst": ("stringId_B", "dst"), "combined": ("score", "combined_score", "combined"),
}
CATALOG_A_HEADERS = {
    "sa": ("SWISS-PROT Accessions Interactor A",), "sb": ("SWISS-PROT Accessions Interactor B",),
    "system": ("Experimental System",), "type": ("Experimental System Type",), "pub": ("Publication Source",),
    "ta": ("TREMBL Accessions Interactor A",), "tb": ("TREMBL Accessions Interactor B",),
    "through": ("Throughput",), "oa": ("Organism ID Interactor A",), "ob": ("Organism ID Interactor B",),
}
