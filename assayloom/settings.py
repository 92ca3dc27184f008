"""Fixed values and defaults shared by the whole package."""

from __future__ import annotations

# --- Fixed values: run defaults -------------------------------------------
TEST_FRACTION = 0.2
VALIDATION_FRACTION = 0.2
RANDOM_SEED = 42
PATIENCE = 10
MAX_EPOCHS = 100
LEARNING_RATE = 1e-3
HASH_BITS = 1024
DICTIONARY_BITS = 167
HASH_RADIUS = 2
CORRELATION_THRESHOLD = 0.9
ACTIVE_THRESHOLD = 7.0
RESAMPLE_BINS = 10
RESAMPLE_P_VALUE = 0.05
RAW_UPPER_BOUND = 1_000_000
DERIVED_BOUNDS = (0.0, 15.0)
NANO = 1e-9

# --- Fixed values: target dimension (id, name, description) -----------------
TARGETS = [
    ("CHEMBL238", "DAT", "Dopamine Transporter"),
    ("CHEMBL224", "5HT2A", "5-Hydroxytryptamine 2A Receptor"),
    ("CHEMBL218", "CB1", "Cannabinoid Receptor 1"),
    ("CHEMBL253", "CB2", "Cannabinoid Receptor 2"),
    ("CHEMBL233", "μ-opioid", "μ-Opioid Receptor"),
    ("CHEMBL236", "δ-opioid", "δ-Opioid Receptor"),
    ("CHEMBL237", "κ-opioid", "κ-Opioid Receptor"),
]

# --- Fixed values: reference entities (target id, name, key text) -----------
REFERENCE_ENTITIES = [
    ("CHEMBL238", "Methamphetamine", "CC(CC1=CC=CC=C1)NC"),
    ("CHEMBL238", "Cocaine", "CN1C2CCC1C(C2)OC(=O)C3=CC=CC=C3C(=O)OC"),
    ("CHEMBL238", "Methylphenidate", "COC(=O)C1=CC=CC=C1C(C)N"),
    ("CHEMBL224", "LSD", "CN(C)C1CCC2=C1C3C(C2)C4=CC=CC=C4N3C"),
    ("CHEMBL224", "DMT", "CN(C)CCC1=CNC2=CC=CC=C12"),
    ("CHEMBL224", "Psilocybin", "COP(=O)(O)OCC1C2=CC=CC=C2NC1"),
    ("CHEMBL218", "WIN 55,212-2", "CN1CC(C2=CC=CC=C2)C(C3=CC=CC=C3)C1"),
    ("CHEMBL218", "CP 55,940", "CC(C)(C)C1=CC2=C(C=C1)C3CC(C2)C4=CC=CC=C4C3"),
    ("CHEMBL1861", "JWH-133", "CC(C)C1=CC2=C(C=C1)C3CC(C2)C4=CC=CC=C4C3"),
    ("CHEMBL1861", "HU-308", "CC(C)C1=CC2=C(C=C1)C3CC(C2)C4=CC=CC=C4C3O"),
    ("CHEMBL233", "Morphine",
     "CN1CC[C@]23C4=C5C=CC(O)=C4O[C@H]2[C@@H](O)C=C[C@H]3[C@H]1C5"),
    ("CHEMBL233", "DAMGO", "CC(C)C[C@H](NC(=O)[C@H](N)CCC(=O)NCC(=O)N)C(=O)NCC(=O)N"),
    ("CHEMBL236", "DPDPE", "CC(C)C[C@H](NC(=O)[C@H](N)CCC(=O)NCC(=O)N)C(=O)NCC(=O)N"),
    ("CHEMBL236", "SNC80", "CC1=CC2=C(C=C1)C3CC(C2)C4=CC=CC=C4C3"),
    ("CHEMBL237", "U-50488", "CC1=CC2=C(C=C1)C3CC(C2)C4=CC=CC=C4C3N"),
    ("CHEMBL237", "Salvinorin A", "CC1=CC2=C(C=C1)C3CC(C2)C4=CC=CC=C4C3OC(=O)C"),
]

# --- Fixed values: linear score, one row per target, None = fallback --------
# (target, logp, donors, acceptors, tpsa, weight, bias)
LINEAR_COEFFICIENTS = [
    ("dat", 0.23, -0.41, -0.19, -0.009, -0.0007, 7.15),
    ("5ht2a", 0.12, -0.65, -0.33, -0.013, -0.0011, 7.60),
    (None, 0.2, -0.5, -0.3, -0.01, -0.001, 7.0),
]
