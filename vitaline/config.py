"""Fixed values of the clinical data model and the default parameters of the operators."""

from __future__ import annotations

import datetime as dt

KEY = ["idana", "idcentro"]

AS_OF = dt.date(2021, 12, 31)
SEED = 42

# Diagnosis codes that count as a cardiovascular event.
CARDIO_CODES = [
    "AMD047",  # myocardial infarction
    "AMD048",  # coronary angioplasty
    "AMD049",  # coronary bypass
    "AMD071",  # ictus
    "AMD081",  # lower-limb angioplasty
    "AMD082",  # lower-limb bypass
    "AMD208",  # revascularisation of head and neck vessels
    "AMD303",  # ischemic stroke
]

# Accepted range of a laboratory value, by code.
LAB_RANGES = {
    "AMD004": (40.0, 200.0),
    "AMD005": (40.0, 130.0),
    "AMD007": (50.0, 500.0),
    "AMD008": (5.0, 15.0),
}
STITCH_RANGES = {
    "STITCH002": (30.0, 300.0),
    "STITCH003": (60.0, 330.0),
}

# A diagnosis code whose value is set to one constant.
DIAGNOSIS_OVERRIDES = {"AMD049": "S", "AMD303": "434.91", "AMD081": "39.5"}

# A code whose missing value has one safe default.
INSTRUMENTAL_FILLS = {"AMD126": "N"}
WEIGHTED_FILL_CODE = "AMD152"
NULL_DROP_CODE = "AMD096"
HEIGHT_CODE = "AMD001"
STITCH_WITHOUT_AMD = ["STITCH003", "STITCH004"]

# Thresholds in days.
MIN_SPAN_DAYS = 31
LABEL_WINDOW_DAYS = 186
MIN_TRAJECTORY_DAYS = 186
NEGATIVE_TRUNCATION_DAYS = 182
POSITIVE_STRIP_DAYS = 186
MIN_EVENTS = 2

# Class balancing.
KEEP_FRACTION = 0.50
JITTER_SIGMA_DAYS = 5.0
COPY_ID_OFFSET = 100000

# Features.
AGE_FACTOR = 1.05
DAYS_PER_MONTH = 31.0
FILL_TEXT = "[UNK]"
FILL_FLAT = -100.0
FILL_ELAPSED = -1.0
PAD_FLAT = -200.0
PAD_ELAPSED = -100.0
PAD_DECAY = 0.0
ELAPSED_STEPS = 512

# Bins are open on the left and closed on the right.
AGE_EDGES = [0, 50, 60, 70, 80, 90, 100, 120]
AGE_LABELS = ["0-50", "51-60", "61-70", "71-80", "81-90", "91-100", "101-120"]
VALUE_EDGES = [0, 25, 50, 75, 100, 150, 200, 300]
VALUE_LABELS = ["0-25", "26-50", "51-75", "76-100", "101-150", "151-200", "201-300"]
REFERENCE_YEAR = 2021

# Patient splits.
SPLIT_60_30_10 = {"train": 0.6, "test": 0.3, "val": 0.1}
SPLIT_80_20 = {"train": 0.8, "test": 0.2}

# Event tables in the order in which every union of them is read.
EXAMS = ["labs", "labs_calc", "instrumental"]
PRESCRIPTIONS = ["rx_drug", "rx_other", "rx_nondiab"]
EVENT_TABLES = ["diagnosi", *EXAMS, *PRESCRIPTIONS]
FEATURE_ORDER = [*EXAMS, *PRESCRIPTIONS, "diagnosi"]
MACRO_MICRO_ORDER = ["diagnosi", *EXAMS, "rx_drug", "rx_other"]

# Row tags, by table, of the flat features ...
FLAT_KIND = {
    "labs": "esame",
    "labs_calc": "esame",
    "instrumental": "esame",
    "rx_drug": "prescrizione",
    "rx_other": "prescrizione",
    "rx_nondiab": "prescrizione",
    "diagnosi": "diagnosi",
}
FLAT_EXTRA = {
    "labs": "parametri",
    "labs_calc": "parametri calcolati",
    "instrumental": "strumentali",
    "rx_drug": "farmaco diabate",
    "rx_other": "non-farmaco diabete",
    "rx_nondiab": "non-diabete",
    "diagnosi": "",
}
# ... and of the elapsed-time features.
ELAPSED_KIND = {
    "labs": "esame parametri",
    "labs_calc": "esame parametri calcolati",
    "instrumental": "esame strumentale",
    "rx_drug": "prescrizione farmaco diabate",
    "rx_other": "prescrizione non-farmaco diabete",
    "rx_nondiab": "prescrizione non-diabete",
    "diagnosi": "diagnosi",
}

# Headings of the history text, in order.
TEXT_HEADINGS = {
    "diagnosi": "diagnosis",
    "labs": "exam parameter",
    "labs_calc": "exam parameter calculated",
    "instrumental": "exam strumental",
    "rx_drug": "prescription diabete drugs",
    "rx_other": "prescription diabete not drugs",
    "rx_nondiab": "prescription not diabete",
}

# English names used in the history text.
ENGLISH_REGISTRY = {
    "idcentro": "idcenter",
    "idana": "idpatient",
    "sesso": "sex",
    "annodiagnosidiabete": "yeardiagnosisdiabetes",
    "scolarita": "levelofeducation",
    "statocivile": "maritalstatus",
    "professione": "profession",
    "annonascita": "yearofbirth",
    "annoprimoaccesso": "yearfirstaccess",
    "annodecesso": "yearofdeath",
}
ENGLISH_EVENT = {
    "idcentro": "idcenter",
    "idana": "idpatient",
    "data": "date",
    "codiceamd": "amdcode",
    "meaning": "meaning",
    "valore": "value",
}
ENGLISH_CALCULATED = {
    "idcentro": "idcenter",
    "idana": "idpatient",
    "data": "date",
    "codiceamd": "amdcode",
    "codicestitch": "stitchcode",
    "meaning": "meaning",
    "valore": "value",
}
ENGLISH_DRUG = {
    "idcentro": "idcenter",
    "idana": "idpatient",
    "data": "date",
    "codiceatc": "atccode",
    "atc_nome": "meaning",
    "quantita": "quantity",
    "idpasto": "idmeal",
    "descrizionefarmaco": "drugdescription",
}

# File stems of the eight tables.
STEMS = {
    "registry": "anagraficapazientiattivi",
    "diagnosi": "diagnosi",
    "labs": "esamilaboratorioparametri",
    "labs_calc": "esamilaboratorioparametricalcolati",
    "instrumental": "esamistrumentali",
    "rx_drug": "prescrizionidiabetefarmaci",
    "rx_other": "prescrizionidiabetenonfarmaci",
    "rx_nondiab": "prescrizioninondiabete",
}
