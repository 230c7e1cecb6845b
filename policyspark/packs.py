"""Policy pack: the fixed values that operators take as parameters.

Every list below is a default; callers with another vocabulary pass their own.
"""

from __future__ import annotations

# Parameters of a record, and their output columns, in order.
PARAM_COLUMNS = {
    "age": "Age",
    "step_therapy_requirements": "Step Therapy Requirements Documented in Policy",
    "steps_through_brands": "Number of Steps through Brands",
    "steps_through_generic": "Number of Steps through Generic",
    "step_through_phototherapy": "Step through-Phototherapy",
    "tb_test_required": "TB Test required",
    "quantity_limits": "Quantity Limits",
    "specialist_types": "Specialist Types",
    "initial_auth_duration": "Initial Authorization Duration(in-months)",
    "reauth_duration": "Reauthorization Duration(in-months)",
    "reauth_required": "Reauthorization Required",
    "reauth_requirements": "Reauthorization Requirements Documented in Policy",
}
PARAMS = list(PARAM_COLUMNS)
OUTPUT_COLUMNS = ["Filename", "Brand", *PARAM_COLUMNS.values(), "Access Score"]

# Spellings of "not available".
NA_FORMS = ["na", "n/a", "not applicable", "not mentioned", "not specified", "not stated", "none", "none mentioned", "none specified", "none required", "not available", "not documented", "unknown", "not addressed", "not indicated", "not listed", ""]
MERGE_NA_FORMS = ["na", "n/a", "not applicable", "not mentioned", "not specified", "not stated", "none", ""]

# Number words in the order in which they are tried.
NUMBER_WORDS = {"zero": 0, "none": 0, "no": 0, "one": 1, "a single": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}

# yes/no wording.
NO_FORMS = ["no", "false", "n", "not required", "no requirement", "no restriction", "not needed"]
YES_FORMS = ["yes", "true", "y", "required", "mandatory"]
YES_PHRASES = ["required", "must", "needed", "necessary", "screening", "is required", "are required", "shall", "should be"]
NO_PHRASES = ["not required", "no requirement", "not needed", "not necessary", "not mandatory", "optional"]

# Wording of other fields.
OPEN_ENDED = ["indefinite", "ongoing", "lifetime", "no limit", "unlimited"]
AGELESS = ["no age", "no restriction", "all ages", "any age", "no limit"]
AGE_PATTERNS = [r"(?:>=|≥|>)\s*(\d+)", r"(\d+)\s*\+", r"(\d+)\s*(?:years?\s*(?:of\s*age|or\s*older|and\s*older))", r"(?:at\s*least|minimum|min)\s*(\d+)", r"age\s*(?:of\s*)?(\d+)"]
ANY_SPECIALIST = ["any provider", "any prescriber", "no specialist", "no requirement", "not required", "any physician"]
SPECIALISTS = ["allergist", "dermatologist", "gastroenterologist", "immunologist", "oncologist", "rheumatologist"]
STEP_NO = ["no", "no step therapy", "no step therapy required", "not required", "no requirements", "false"]
STEP_YES = ["yes", "true", "required", "step therapy required"]
STEP_WORDS = ["must", "require", "fail", "tried", "prior", "step"]
LIMIT_NO = ["no", "false", "no quantity limit", "no limits"]
DOSAGE_WORDS = ["mg", "inject", "subcutaneous", "dose", "loading", "maintenance", "every", "week"]
LIMIT_WORDS = ["quantity", "supply", "limit", "ql", "day supply", "units per"]

# Brands, their generic names and labelled ages.
BRAND_GENERIC = {"TREMFYA": "guselkumab", "STELARA": "ustekinumab", "ENBREL": "etanercept", "AMJEVITA": "adalimumab-atto", "COSENTYX": "secukinumab", "REMICADE": "infliximab", "SILIQ": "brodalumab", "CIMZIA": "certolizumab", "BIMZELX": "bimekizumab", "SKYRIZI": "risankizumab", "OTEZLA": "apremilast", "YESINTEK": "ustekinumab-kfce", "OTULFI": "ustekinumab-aauz", "ILUMYA": "tildrakizumab", "ACITRETIN": "acitretin"}
LABEL_AGE = {"TREMFYA": ">=18", "STELARA": ">=6", "ENBREL": ">=4", "COSENTYX": ">=6", "AMJEVITA": ">=18", "REMICADE": ">=18", "SILIQ": ">=18", "CIMZIA": ">=18", "BIMZELX": ">=18", "SKYRIZI": ">=18", "OTEZLA": ">=18", "YESINTEK": ">=6", "OTULFI": ">=18", "ILUMYA": ">=18", "ACITRETIN": "No"}
BIOLOGICS = ["bimzelx", "cimzia", "cosentyx", "enbrel", "humira", "ilumya", "otezla", "remicade", "siliq", "skyrizi", "sotyktu", "stelara", "taltz", "tremfya", "simponi", "orencia", "actemra", "kevzara", "kineret", "entyvio", "rinvoq", "xeljanz", "olumiant", "tysabri"]
BIOSIMILARS = ["amjevita", "avsola", "cyltezo", "hadlima", "hulio", "hyrimoz", "idacio", "imuldosa", "inflectra", "otulfi", "psychiva", "quallent", "renflexis", "selarsdi", "steqeyma", "wezlana", "yesintek", "yuflyma", "yusimry"]
GENERICS = ["methotrexate", "cyclosporine", "acitretin", "apremilast", "calcipotriene", "tazarotene", "anthralin", "coal tar", "salicylic acid", "sulfasalazine", "leflunomide", "hydroxychloroquine", "vtama", "zoryve"]

# Reauthorisation wording.
STRICT_REAUTH = [r"pasi[\s\-]*\d+", r"bsa.*\d+\s*%", r"dlqi.*\d+", r"lab\s+value", r"documented.*reduction.*\d+", r"at\s+least\s+\d+\s*%", r"score.*\d+"]
LENIENT_REAUTH = ["benefit", "improvement", "stabiliz", r"response\s+to\s+therapy", "continue.*to.*respond", r"has\s+responded", r"clinical\s+response"]

# Page relevance. Category: keywords and weight.
PAGE_KEYWORDS = {
    "disease": (["psoriasis", "plaque", "pso"], 3.0),
    "other_brands": (["tremfya", "guselkumab", "stelara", "ustekinumab", "enbrel", "etanercept", "amjevita", "adalimumab", "cosentyx", "secukinumab", "remicade", "infliximab", "siliq", "brodalumab", "cimzia", "certolizumab", "bimzelx", "bimekizumab", "skyrizi", "risankizumab", "otezla", "apremilast", "yesintek", "otulfi", "ilumya", "tildrakizumab", "acitretin"], 0.5),
    "secondary": (["step therapy", "prior treatment", "tried and failed", "inadequate response", "intolerance", "contraindication", "authorization duration", "approval period", "length of authorization", "reauthorization", "renewal", "continuation", "quantity limit", "quantity level limit", "specialist", "dermatologist", "prescriber", "tuberculosis", "tb test", "tb screen", "quantiferon", "latent tb", "phototherapy", "uvb", "puva", "psoralen"], 1.0),
    "universal": (["general authorization", "general criteria", "all medications", "all indications", "non-preferred", "preferred agent", "applies to all", "for all requests", "for all diagnoses", "regardless of indication", "criteria for all"], 2.0),
    "reauthorization": (["reauthorization", "renewal", "continuation criteria", "continuation of therapy", "renewal criteria"], 1.5),
    "quantity_limit": (["quantity limit", "quantity level limit"], 2.0),
}
TARGET_WEIGHT = 5.0
# Keywords of each parameter, for paragraphs, sentences and snippets.
PARAM_KEYWORDS = {
    "age": ["years of age", "age of", ">=18", ">=6", ">=4", "pediatric", "adolescent", "adult patient", "years or older", "age restriction"],
    "step_therapy": ["step therapy", "tried and failed", "inadequate response", "prior treatment", "failed to respond", "intolerance", "contraindication", "conventional", "prerequisite", "trial and failure", "trial of", "failed", "must have tried", "documented failure", "treatment history", "previous therapy", "prior use"],
    "branded_steps": ["preferred agent", "non-preferred", "biologic", "biosimilar", "targeted immune", "targeted synthetic", "preferred alternative", "formulary alternative"],
    "generic_steps": ["methotrexate", "cyclosporine", "acitretin", "topical", "conventional synthetic", "non-biologic", "leflunomide", "conventional therapy", "first-line"],
    "phototherapy": ["phototherapy", "puva", "uvb", "psoralen", "light therapy", "light treatment", "narrowband"],
    "tb_test": ["tuberculosis", "tb test", "tb screen", "quantiferon", "latent tb", "tb testing", "ppd"],
    "quantity_limit": ["quantity limit", "quantity level limit", "supply limit", "day supply"],
    "specialist": ["dermatologist", "specialist", "prescriber type", "prescribed by", "in consultation with", "board-certified", "treating physician"],
    "auth_duration": ["authorization duration", "approval period", "authorized for", "approve for", "approved for", "length of authorization", "initial authorization", "valid for", "12 months", "6 months", "one year", "365 days"],
    "reauth": ["reauthorization", "renewal", "continuation criteria", "continuation of therapy", "re-authorization", "continued approval", "renewal criteria", "subsequent authorization", "follow-up approval", "recertification"],
}
# Section headers, and marks of layouts and criteria.
SECTION_PATTERNS = [r"^products?\s+affected", r"^drug\s+name\s*:", r"^\s*(?:brand|generic)\s+name\s*:", r"(?:plaque\s+psoriasis|psoriatic\s+arthritis|crohn|ulcerative\s+colitis)"]
UNIVERSAL_PATTERNS = [r"general\s+authorization\s+guidelines", r"general\s+criteria", r"criteria\s+for\s+all", r"applies?\s+to\s+all", r"for\s+all\s+(medications|indications|requests|diagnoses)", r"documentation\s+for\s+all\s+indications"]
TIER_PATTERNS = [r"non-preferred.*require.*trial.*(?:preferred|formulary)", r"non-preferred.*(?:agents?|products?).*require"]
CATALOG_MARKS = ["products affected", "pa criteria"]
JUMP_PATTERN = r"go\s+to\s+#?\s*\d+"
REAUTH_WORDS = ["reauthorization", "renewal criteria", "continuation criteria", "continuation of therapy", "renewal approval", "re-authorization"]
LIMIT_PHRASES = ["quantity limit", "quantity level limit"]
LAYOUT_MARKS = ["products affected", "prior authorization criteria", "criteria details", "required medical information"]
APPROVAL_PHRASES = ["coverage of {}", "{} may be approved", "{} is considered"]
CRITERIA_MARKS = ["all of the following criteria", "criteria are met", "criteria for initial approval", "approval criteria"]
NEAR_WORDS = ["criteria", "authorization", "approval", "trial", "failed", "all of the following"]
SIGNAL_WORDS = ["plaque psoriasis", "psoriasis", "body surface area", "moderate-to-severe", "moderate to severe", "plaque pso"]
SIGNAL_PATTERN = r"\bbsa\b|\bplaque\b"
OTHER_INDICATIONS = ["psoriatic arthritis", "ulcerative colitis", "crohn", "rheumatoid arthritis", "ankylosing spondylitis", "hidradenitis suppurativa"]
STUDY_PATTERNS = ["et al", r"\(\d{4}\)", r"\bstudy\b", r"\btrial\b", r"\brandomized\b", r"\bplacebo\b", r"\befficacy\b", r"patients.*n\s*=", "meta-analysis", "systematic review", "case.?series", r"\bcohort\b", r"\bresponders?\b", "double.?blind", r"phase\s+[iI]{1,3}"]
POLICY_PATTERNS = ["authorization", r"\bcriteria\b", r"\bapproval\b", "step therapy", "prior auth", "precertification", "medically necessary", r"\bcoverage\b", r"\bformulary\b", r"\bpreferred\b", "non-preferred", "reauthorization", r"\brenewal\b", "quantity limit", r"\btier\b"]
AND_MARKERS = ["all of the following", "each of the following", "must meet all", "a. through"]
OR_MARKERS = ["one of the following", "any of the following", "either of the following", "one (1) of", "any (1) of", "meets one", "meets any"]
CHUNK_KEYWORDS = ["plaque psoriasis", "psoriasis", "moderate to severe", "step therapy", "trial and failure", "tried and failed", "must have tried", "conventional therapy", "systemic therapy", "biologic", "non-biologic", "methotrexate", "cyclosporine", "acitretin", "phototherapy", "puva", "uvb", "topical", "tb test", "tuberculosis", "latent tb", "initial authorization", "authorization duration", "coverage duration", "reauthorization", "renewal criteria", "continuation criteria", "quantity limit", "quantity limits", "prior authorization", "coverage criteria", "approval criteria", "age restriction", "prescriber restriction", "specialist", "dermatologist"]

# Consistency and drift.
MUST_MATCH = ["tb_test_required", "specialist_types", "step_through_phototherapy", "quantity_limits"]
MUST_BE_NEAR = {"initial_auth_duration": 6, "reauth_duration": 6}
EXPECTED = {
    "STELARA": {"age": {"No": 45, ">=6": 40}, "steps_through_generic": {"1": 70, "2": 20, "NA": 10}, "steps_through_brands": {"NA": 85}, "step_through_phototherapy": {"No": 95}, "tb_test_required": {"Yes": 55, "No": 45}, "initial_auth_duration": {"12": 65, "6": 30}, "reauth_required": {"Yes": 65, "No": 35}, "specialist_types": {"Dermatologist": 40, "NA": 35}, "quantity_limits": {"No": 85}},
    "TREMFYA": {"age": {"No": 81, ">=18": 14}, "steps_through_generic": {"NA": 52, "1": 48}, "steps_through_brands": {"NA": 76}, "step_through_phototherapy": {"No": 100}, "tb_test_required": {"Yes": 52, "No": 48}, "initial_auth_duration": {"12": 57, "Unspecified": 24, "6": 19}, "reauth_required": {"Yes": 57, "No": 43}, "specialist_types": {"NA": 62, "Dermatologist": 33}, "quantity_limits": {"No": 86}},
}
# Parameters whose values have a simple form.
SIMPLE_PARAMS = ["age", "tb_test_required", "quantity_limits", "specialist_types", "initial_auth_duration", "reauth_duration", "reauth_required"]
# What a task gets when nothing could be extracted.
DEFAULTS = {"age": "No", "step_therapy_requirements": "Unspecified", "steps_through_brands": "NA", "steps_through_generic": "1", "step_through_phototherapy": "No", "tb_test_required": "Y", "quantity_limits": "NA", "specialist_types": "NA", "initial_auth_duration": "12", "reauth_duration": "Unspecified", "reauth_required": "Yes", "reauth_requirements": "Unspecified"}
BRAND_DEFAULTS = {"STELARA": {"age": ">=6"}}

# Names that a section of the labelled layout can have for a drug.
DRUG_ALIASES = {"ACITRETIN": ["ACITRETIN", "SORIATANE"], "SKYRIZI": ["SKYRIZI", "RISANKIZUMAB"], "TREMFYA": ["TREMFYA", "GUSELKUMAB"], "STELARA": ["STELARA", "USTEKINUMAB"], "ILUMYA": ["ILUMYA", "TILDRAKIZUMAB"], "COSENTYX": ["COSENTYX", "SECUKINUMAB"], "TALTZ": ["TALTZ", "IXEKIZUMAB"], "HUMIRA": ["HUMIRA", "ADALIMUMAB"], "ENBREL": ["ENBREL", "ETANERCEPT"], "CIMZIA": ["CIMZIA", "CERTOLIZUMAB"], "SIMPONI": ["SIMPONI", "GOLIMUMAB"], "OTEZLA": ["OTEZLA", "APREMILAST"], "SOTYKTU": ["SOTYKTU", "DEUCRAVACITINIB"], "RINVOQ": ["RINVOQ", "UPADACITINIB"], "XELJANZ": ["XELJANZ", "TOFACITINIB"], "BIMZELX": ["BIMZELX", "BIMEKIZUMAB"], "SILIQ": ["SILIQ", "BRODALUMAB"]}
# Marks of the page where a drug's section starts, and of pages that start a section.
START_MARKS = ["products affected", "drug names", "prior authorization group"]
SECTION_MARKS = ["products affected"]
SECTION_SECOND_MARKS = ["prior authorization criteria", "criteria details"]
# Words of sentences about reauthorisation, for the step analysis.
REAUTH_SENTENCE_WORDS = ["reauthorization", "renewal", "continuation criteria", "continuation of therapy", "re-authorization", "continued approval", "renewal criteria", "reauthorization requirements"]
# The keyword list of a parameter's snippet.
SNIPPET_KEYWORDS = {"tb_test_required": "tb_test", "reauth_required": "reauth", "age": "age", "initial_auth_duration": "auth_duration", "reauth_duration": "reauth", "specialist_types": "specialist", "quantity_limits": "quantity_limit"}
# Spellings that a second pass may fill.
GAP_FORMS = ["na", "n/a", "not applicable", "not mentioned", ""]
# A marker that begins a piece of a context, and parameters of the second of two calls.
CONTEXT_MARK = r"\[(?:Universal|PsO Section|Tier \d|Page)[^\]]*\]"
COMPLEX_PARAMS = ["step_therapy_requirements", "steps_through_brands", "steps_through_generic", "step_through_phototherapy", "reauth_requirements"]
REQUIRED_COMPLEX = ["step_through_phototherapy", "steps_through_brands", "steps_through_generic"]

#: Names under which a page can mention a brand, and the brand that each stands for.
CANONICAL = {w: next((b.lower() for b, g in BRAND_GENERIC.items() if w in (b.lower(), g)), w) for w in PAGE_KEYWORDS["other_brands"][0]}
