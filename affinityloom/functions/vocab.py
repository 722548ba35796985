"""Vocabularies, unit factors and thresholds that results depend on."""

# Assay source priority, 1 is preferred; others rank 99.
SOURCE_PRIORITY = {"SKEMPI": 1, "PDBbind": 2, "BioLiP": 3, "BindingDB": 4, "ChEMBL": 5}
UNKNOWN_PRIORITY = 99

# Unit to nanomolar.
NANOMOLAR_FACTORS = {
    "fm": 0.000001,
    "pm": 0.001,
    "nm": 1.0,
    "um": 1000.0,
    "mm": 1000000.0,
    "m": 1000000000.0,
}

# Gas constant in kcal/(mol K) and default temperature in K.
GAS_CONSTANT = 1.987e-3
DEFAULT_TEMPERATURE_K = 298.15

# Component ids of free metal and halide ions.
METAL_IONS = (
    "LI NA K RB CS MG CA SR BA V CR MN FE CO NI CU ZN MO TC RU RH PD AG CD W RE OS IR PT AU HG "
    "AL GA IN TL SN PB BI AS SE TE F CL BR IOD LA CE PR ND SM EU GD TB DY HO ER TM YB LU "
    "FE2 FE3 CU1 MN3 VO4"
).split()

# Component ids of biochemical cofactors.
COFACTORS = (
    "ATP ADP AMP ANP APC AGS GTP GDP GMP GNP CTP CDP UTP UDP TTP TDP NAD NADH NAP NHD NDP NHE "
    "FAD FMN COA CNA 3CO HEM HEC HEA HEB HDD CLN PLP PMP TPP SAM SAH BTN LPA B12 CBL CLA BCL "
    "SF4 F3S FES FEO ACO MGD MTE UQ1 RET RBT"
).split()

# Component ids of sugars.
SUGARS = (
    "NAG NDG NGA BMA MAN MAF GAL GLA FUC FCA SIA SLB GLC BGC XYS XYL AFL GCS RIB RHA"
).split()

# Component ids of solvents, buffers and crystallisation additives.
ADDITIVES = (
    "HOH DOD SO4 PO4 HPO H2P PEP CL NA MG ZN CA K MN FE NI CU CD CO BR IOD F CS RB SR BA AU HG "
    "PT PB GOL EDO PEG MPD PG4 PGE FMT ACT ACE ACY ETH DMS MES TRS HEP BME EPE MLI SUC TAR AZI "
    "IMD NH2 NO3 CIT ACN EOH IPA TFP DIO DMF XPE P6G NH4 OXY"
).split()

# Cofactors that carry a metal.
METALLO_COFACTORS = "HEM HEC HEA HEB HDD CLN FES SF4 F3S FEO ACO MGD MTE CLA BCL B12 CBL".split()

# Polymer type names.
PROTEIN_POLYMERS = ["polypeptide(l)", "polypeptide(d)"]
NUCLEIC_POLYMERS = [
    "polyribonucleotide",
    "polydeoxyribonucleotide",
    "polyribonucleotide/polydeoxyribonucleotide hybrid",
]
GLYCAN_POLYMERS = ["polysaccharide(d)", "polysaccharide(l)"]
PEPTIDE_MAX_RESIDUES = 30

# Distance shells in angstrom, both ends inclusive.
SHELLS = [("shell_1", 0.0, 3.5), ("shell_2", 3.5, 6.0), ("shell_3", 6.0, 8.0)]

# Residue letters and the Kyte-Doolittle hydropathy scale.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5,
    "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8,
    "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}

# Text fragments that mark a membrane protein.
MEMBRANE_KEYWORDS = [
    "membrane protein", "transmembrane", "gpcr", "g protein-coupled", "ion channel", "transporter",
    "receptor tyrosine kinase", "integrin", "aquaporin", "abc transporter", "membrane receptor",
    "lipid bilayer", "detergent", "micelle", "photosystem", "thylakoid", "photosynthesis",
    "light harvesting", "dhhc", "palmitoyl", "palmitoyltransferase", "cytochrome bc1",
    "cytochrome c oxidase", "nadh dehydrogenase", "atp synthase",
]

# Title fragments that mark a covalent complex.
COVALENT_TITLES = [
    "covalent inhibitor", "covalent complex", "acyl-enzyme", "acyl enzyme", "covalent adduct",
    "irreversible inhibitor", "irreversibly inhibited", "irreversibly inactivated", "covalently bound",
    "covalently modified",
]

# Text fragments that mark glycosylation, and metals named in text.
GLYCAN_KEYWORDS = ["glycosylated", "glycoprotein", "glycan", "fucosylated", "sialylated", "oligosaccharide"]
METAL_KEYWORDS = [
    ("nickel", "NI"), ("zn(", "ZN"), ("zinc", "ZN"), ("cobalt", "CO"), ("manganese", "MN"),
    ("magnesium", "MG"), ("calcium", "CA"),
]

# Reactive-group patterns in ligand strings.
REACTIVE_GROUPS = [
    r"C=CC\(=O\)N", r"C=CC\(=O\)O", r"C=CS\(=O\)", r"C1CO1", r"ClCC[CN]", r"BrCC[CN]", r"ClC\(=O\)",
    r"C=C[^(].*C=O", r"\[N\+\].*\[O-\]",
]

# Alkali counter-ions that do not count as a bound metal.
ALKALI_IONS = ["LI", "NA", "K", "RB", "CS"]
