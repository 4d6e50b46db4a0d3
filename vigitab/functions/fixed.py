"""Fixed values. These lists must equal the published definitions for right results."""

# fixed values: salt words removed from the end of a name
SALT_WORDS = [
    "hydrochloride", "hydrobromide", "sodium", "potassium", "calcium", "magnesium",
    "acetate", "mesylate", "maleate", "fumarate", "succinate", "tartrate", "citrate",
    "phosphate", "sulfate", "sulphate", "nitrate", "tosylate", "besylate", "malate",
    "chloride", "dihydrate", "monohydrate", "hydrate", "anhydrous", "recombinant",
]

# fixed values: dosage-form words removed anywhere in a name
FORM_WORDS = [
    "tablet", "tablets", "capsule", "capsules", "injection", "injectable", "solution",
    "oral", "intravenous", "subcutaneous", "infusion", "extended", "release", "film",
    "coated", "powder", "suspension", "cream", "gel", "spray", "patch",
    "lotion", "ophthalmic", "topical", "vial", "unk", "unknown", "w",
]

# fixed values: words removed by the intervention cleanup
AGENT_WORDS = [
    "tablet", "tablets", "capsule", "capsules", "oral", "injection", "infusion", "solution", "iv",
    "intravenous", "subcutaneous", "film", "coated", "extended", "release", "matching",
    "hydrochloride", "hcl", "sodium", "sulfate", "sulphate", "mesylate", "maleate", "tartrate",
    "citrate", "acetate", "phosphate", "succinate", "fumarate", "besylate", "dihydrate", "monohydrate",
]

# fixed values: salt, ester and prodrug review words
SALT_REVIEW_WORDS = [
    "hydrochloride", "hydrobromide", "sodium", "potassium", "calcium", "acetate", "mesylate",
    "maleate", "fumarate", "succinate", "tartrate", "citrate", "phosphate", "sulfate", "sulphate",
    "nitrate", "ester", "prodrug",
]

# fixed values: notes that mark an administrative conversion
ADMIN_NOTES = ["transition product", "new license number"]

# fixed values: strength and bracket patterns
STRENGTH = r"\b[0-9]+([.,][0-9]+)?\s*(mg|mcg|ug|g|kg|ml|l|iu|units?|%)\b"
BRACKETS = r"\([^)]*\)|\[[^\]]*\]"

# fixed values: placebo and control tokens of the intervention and of the arm title
PLACEBO_INTERVENTION = [
    "placebo", "inactive placebo", "vehicle", "sham", "dummy", "sugar pill", "no treatment",
    "control", "comparator", "saline",
]
PLACEBO_TITLE = ["placebo", "vehicle", "sham", "no treatment", "control"]

# fixed values: oncology words of a condition name
ONCOLOGY_WORDS = [
    "cancer", "carcinoma", "leukemia", "leukaemia", "lymphoma", "melanoma", "neoplasm",
    "tumor", "tumour", "myeloma",
]

# fixed values: indication containers, first match wins
INDICATION_CONTAINERS = [
    ("product used for unknown indication", "product used for unknown indication"),
    ("off label use", "off-label use"),
    ("premedication", "premedication"),
    ("prophylaxis", "prophylaxis"),
]

# fixed values: route and form classes, first match wins
ROUTE_CLASSES = [
    ("oral", "ORAL"), ("inject", "PARENTERAL"), ("intravenous", "PARENTERAL"),
    ("subcutaneous", "PARENTERAL"), ("intrathecal", "PARENTERAL"),
    ("ophthalmic", "OPHTHALMIC"), ("inhal", "INHALATION"),
]
FORM_CLASSES = [
    ("inject", "INJECTABLE"), ("solution", "LIQUID"), ("suspension", "LIQUID"),
    ("tablet", "SOLID"), ("capsule", "SOLID"), ("granule", "SOLID"), ("powder", "SOLID"),
]

# fixed values: development-code pattern
DEV_CODE = r"^[A-Za-z]{1,8}[- ]?\d{2,}[A-Za-z0-9-]*$"

# fixed values: boundary-scan patterns
BOUNDARY_PATTERNS = {
    "local user path": "/Users/",
    "api secret": r"sk-[A-Za-z0-9_-]{20,}",
    "repository token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "cloud access key": r"AKIA[0-9A-Z]{16}",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "assigned secret": r"(?i)(?:api[_-]?key|access[_-]?token|password|passwd|secret)\s*[:=]\s*[\"'][^\"']{8,}[\"']",
}

# fixed values: statistical constants
Z95 = 1.96
IC_SHRINK = 0.5
IC_LOW_1 = 3.3
IC_LOW_2 = 2.0
PRED_CLIP = 1e-6
DOUBLE_EPS = 2.220446049250313e-16
RARE_MIN_ENTITIES = 5
RARE_LEVEL = "PT_RARE"
VOLUME_MINIMA = [0, 50, 100, 200, 500]
VOLUME_TIERS = [1, 50, 100, 200, 500]
HORIZONS = [1, 2, 3]
