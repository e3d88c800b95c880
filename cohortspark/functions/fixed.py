"""Fixed values. They must equal the agreed ones for results to agree.

``AXIS_LABELS`` also fixes which pattern counts first.
"""

# Identifiers that never name a patient.
STOP_IDS = ["unknown", "anonymous", "none", "test", "patient"]

# Vessel classes.
CLASS_LABELS = ["A", "B", "C", "D", "AB", "AC", "AD", "BC", "BD", "NG"]

# Class to training category, category to code, phase folder to code.
CLASS_CATEGORY = {
    "A": "A", "C": "A", "AC": "A", "AB": "A", "AD": "A",
    "B": "B", "BC": "B", "BD": "B",
    "D": "D",
    "NG": "NG",
}
CATEGORY_CODE = {"A": 0, "B": 1, "D": 2, "NG": 3}
PHASE_CODE = {"NC": 0, "ART": 1, "VEN": 2}

# Phases.
PHASES = ["nc", "art", "ven", "delay"]

# Keywords per phase, already lower-cased with "_", "/" and "-" as spaces.
EXCLUDED_WORDS = [
    "recon", "mpr", "mip", "vr", "summary", "reformatted", "localizer",
    "smart prep", "timing run", "test dose", "chest", "lungs", "lung",
]
NATIVE_WORDS = [
    "unenhanced", "non contrast", "no contrast", "without contrast",
    "pre contrast", "precontrast", "native", "baseline", "w o", "plain",
    "stone protocol", "renal colic",
]
ARTERIAL_WORDS = [
    "arterial", "arterial phase", "corticomedullary", "early arterial", "late arterial", "cta", "angio", "art",
]
DELAYED_WORDS = [
    "delay", "delayed", "delays", "excretory", "excretion", "urogram", "urographic", "ivp",
    "3 min", "5 min", "8 min", "10 min", "12 min",
]
VENOUS_WORDS = [
    "venous", "venous phase", "portal venous", "porto venous", "portovenous",
    "nephro", "nephrographic", "nephrographic phase", "parenchymal", "parenchymal phase", "ven", "pv",
]

# Scan plane keywords, in order.
PLANE_WORDS = [
    ("AXIAL", "AXIAL"), (" AX ", "AXIAL"), ("TRANSVERSE", "AXIAL"),
    ("CORONAL", "CORONAL"), (" COR ", "CORONAL"),
    ("SAGITTAL", "SAGITTAL"), (" SAG ", "SAGITTAL"),
]

# Header tags.
TAG_PATIENT_ID = "0010|0020"
TAG_PATIENT_NAME = "0010|0010"
TAG_OTHER_IDS = "0010|1000"
TAG_ORIENTATION = "0020|0037"
TAG_DESCRIPTION = "0008|103e"
TAG_PROTOCOL_NAME = "0018|1030"
TAG_SEQUENCE_NAME = "0018|0024"
TAG_MODALITY = "0008|0060"
METADATA_TAGS = {
    "image_orientation": "0020|0037",
    "sex": "0010|0040",
    "DOB": "0010|0030",
    "age": "0010|1010",
    "DOS": "0008|0020",
    "study_time": "0008|0030",
    "series_description": "0008|103e",
    "series_number": "0020|0011",
    "modality": "0008|0060",
    "manufacturer": "0008|0070",
    "manufacturer_model": "0008|1090",
    "institution": "0008|0080",
    "kvp": "0018|0060",
    "contrast_agent": "0018|0010",
    "slice_thickness": "0018|0050",
}

# Candidate headers of the label tables.
PATIENT_HEADERS = ["TCGA ID", "patient_id", "PatientID", "ID"]
CLASS_HEADERS = ["Vessel evaluation", "class", "Class", "Label", "group", "Group"]
CASE_HEADERS = ["case_id", "CaseID", "Case"]
ALIAS_HEADERS = ["Anonym", "ID", "Manual Label", "LB", "HB", "SN"]

# Patch budget and role shares per lesion size bin; the default row serves all other bins.
PATCH_BUDGET = {"tiny": 2, "small": 2, "medium": 3, "large": 4, "huge": 5}
PATCH_BUDGET_DEFAULT = 3
ROLE_PRIORS = {
    "tiny": (0.85, 0.10, 0.05),
    "small": (0.65, 0.25, 0.10),
    "medium": (0.50, 0.30, 0.20),
    "large": (0.40, 0.35, 0.25),
    "huge": (0.30, 0.40, 0.30),
}
ROLE_PRIORS_DEFAULT = (0.50, 0.30, 0.20)
ROLES = ("center", "border", "context")
SIZE_BIN_LABELS = ["tiny", "small", "medium", "large", "huge"]

# Axis label and scale per kind of metric, in order of precedence (kind is a pattern).
AXIS_LABELS = [
    ("psnr", "PSNR (dB)", 1.0),
    ("ssim", "SSIM (index)", 1.0),
    ("accuracy", "Accuracy (%)", 100.0),
    ("precision", "Precision (%)", 100.0),
    ("recall", "Recall (%)", 100.0),
    ("(^|[/_])f1($|[/_])", "F1 (%)", 100.0),
    ("sensitivity", "Sensitivity (%)", 100.0),
    ("specificity", "Specificity (%)", 100.0),
    ("auc", "AUC (index)", 1.0),
    ("probe_acc", "Probe accuracy (%)", 100.0),
    ("loss_d", "Discriminator loss (a.u.)", 1.0),
    ("g_adv|adversarial", "Generator adversarial loss (a.u.)", 1.0),
    ("perceptual", "Perceptual loss (a.u.)", 1.0),
    ("(^|[/_])kl$", "KL divergence (a.u.)", 1.0),
    ("recon", "Reconstruction loss (a.u.)", 1.0),
    ("loss", "Loss (a.u.)", 1.0),
]

# Class merges and compared groups of the radiomics study, and its identifier columns.
STUDY_MERGES = {"C": "A", "AB": "A", "AC": "A", "BC": "B"}
STUDY_GROUPS = ["A", "B"]
STUDY_ID_COLUMNS = [
    "sample_id", "patient_id", "case_id", "side", "image_path", "mask_path",
    "class_raw", "group_label", "dominant_label", "contains_d", "contrast_phase",
]
