"""Dictionaries, patterns and constants that must equal the reference behaviour.

Every operator takes these as parameters; the values below are defaults. Large
vocabularies (the skill list, synonym and weight tables) are *not* shipped:
pass them as DataFrames or dicts built from your own data.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Degree ladder used when fitting (whole-word match), term -> level.
# ---------------------------------------------------------------------------
DEGREE_LEVELS_TRAINING: dict[str, float] = {
    "phd": 5, "doctor": 5, "doctorate": 5, "dba": 5, "md": 5, "jd": 5, "edd": 5,
    "d.phil": 5, "ph.d": 5, "doctoral": 5, "dphil": 5, "dsci": 5, "sc.d": 5, "s.j.d": 5,
    "engd": 5, "deng": 5, "dsc": 5, "d.sc": 5, "dlit": 5, "d lit": 5, "dha": 5,
    "master": 4, "masters": 4, "mba": 4, "ms": 4, "m.s": 4, "m.sc": 4, "m.tech": 4,
    "ma": 4, "m.a": 4, "mfa": 4, "m.f.a": 4, "msc": 4, "meng": 4, "m.eng": 4,
    "mphil": 4, "m.phil": 4, "mres": 4, "m.res": 4, "llm": 4, "l.l.m": 4,
    "med": 4, "m.ed": 4, "msw": 4, "m.s.w": 4, "mph": 4, "m.p.h": 4,
    "mpa": 4, "m.p.a": 4, "emba": 4, "pgdip": 4, "pg diploma": 4, "post graduate diploma": 4,
    "bachelor": 3, "bachelors": 3, "bs": 3, "b.s": 3, "b.tech": 3, "ba": 3, "b.a": 3,
    "b.sc": 3, "bsc": 3, "bfa": 3, "b.f.a": 3, "beng": 3, "b.eng": 3, "bba": 3, "b.b.a": 3,
    "bed": 3, "b.ed": 3, "llb": 3, "l.l.b": 3, "bcom": 3, "b.com": 3, "bca": 3, "b.c.a": 3,
    "barch": 3, "b.arch": 3, "bdes": 3, "b.des": 3, "undergraduate": 3, "honours": 3,
    "graduate": 3, "btech": 3, "be": 3, "b.e": 3,
    "associate": 2, "associates": 2, "diploma": 2, "hnd": 2, "foundation degree": 2,
    "a.a": 2, "aa": 2, "a.s": 2, "as": 2, "a.a.s": 2, "aas": 2, "vocational": 2,
    "technical diploma": 2, "technical certificate": 2, "professional diploma": 2,
    "advanced diploma": 2, "higher diploma": 2, "apprenticeship": 2,
    "high school": 1, "secondary": 1, "secondary school": 1, "high school diploma": 1,
    "ged": 1, "hsed": 1, "hse": 1, "gcse": 1, "a level": 1, "a-level": 1, "o level": 1,
    "higher secondary": 1, "hsc": 1, "intermediate": 1, "12th grade": 1, "12th": 1,
    "senior secondary": 1, "baccalaureate": 1,
}

# ---------------------------------------------------------------------------
# Degree ladder used when screening (substring match), term -> level.
# ---------------------------------------------------------------------------
DEGREE_LEVELS_SERVING: dict[str, float] = {
    "phd": 5, "ph.d.": 5, "ph.d": 5, "doctorate": 5, "doctoral": 5, "doctor of philosophy": 5,
    "doctor of education": 5, "ed.d": 5, "ed.d.": 5, "doctor of business administration": 5,
    "dba": 5, "d.b.a.": 5, "doctor of medicine": 5, "md": 5, "m.d.": 5, "doctor of engineering": 5,
    "eng.d": 5, "doctor of science": 5, "sc.d": 5, "doctor of law": 5, "j.d.": 5, "jd": 5,
    "juris doctor": 5,
    "master": 4, "masters": 4, "master of science": 4, "master of arts": 4,
    "master of business administration": 4, "master of engineering": 4, "master of education": 4,
    "master of fine arts": 4, "master of public administration": 4, "master of public health": 4,
    "master of social work": 4, "master of laws": 4, "master of architecture": 4, "m.s.": 4,
    "ms": 4, "m.a.": 4, "ma": 4, "mba": 4, "m.b.a.": 4, "m.eng": 4, "meng": 4, "med": 4,
    "m.ed": 4, "mfa": 4, "m.f.a.": 4, "mpa": 4, "mph": 4, "msw": 4, "ll.m": 4, "llm": 4,
    "m.arch": 4, "march": 4, "postgraduate": 4, "post-graduate": 4, "graduate degree": 4,
    "bachelor": 3, "bachelors": 3, "baccalaureate": 3, "bachelor of science": 3,
    "bachelor of arts": 3, "bachelor of business administration": 3, "bachelor of engineering": 3,
    "bachelor of education": 3, "bachelor of fine arts": 3, "bachelor of architecture": 3,
    "bachelor of technology": 3, "b.s.": 3, "bs": 3, "b.a.": 3, "ba": 3, "b.b.a.": 3, "bba": 3,
    "b.eng": 3, "beng": 3, "b.ed": 3, "bed": 3, "bfa": 3, "b.f.a.": 3, "b.arch": 3, "barch": 3,
    "b.tech": 3, "btech": 3, "undergraduate": 3, "undergraduate degree": 3,
    "associate": 2, "associates": 2, "associate degree": 2, "associate of arts": 2,
    "associate of science": 2, "associate of applied science": 2, "a.a.": 2, "aa": 2, "a.s.": 2,
    "as": 2, "a.a.s.": 2, "aas": 2, "foundation degree": 2, "technical degree": 2,
    "vocational degree": 2, "diploma": 2, "advanced diploma": 2, "2-year degree": 2,
    "two-year degree": 2, "community college": 2,
    "high school": 1, "high school diploma": 1, "high school degree": 1, "secondary education": 1,
    "secondary school": 1, "ged": 1, "general education diploma": 1,
    "general educational development": 1, "secondary diploma": 1, "hsd": 1, "hsed": 1,
    "high school equivalency diploma": 1, "a-levels": 1, "advanced levels": 1,
    "no degree": 0, "no formal education": 0, "self-taught": 0, "self taught": 0,
    "some college": 0.5, "some university": 0.5, "incomplete degree": 0.5, "coursework": 0.5,
}

# ---------------------------------------------------------------------------
# Contact patterns (Python/Java regex syntax), phone patterns in
# priority order.
# ---------------------------------------------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERNS = [
    r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"(?:\+?\d{1,3}[-.\s]?)?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    r"(?:\+?\d{1,3}[-.\s]?)?\d{10}",
    r"\+\d{1,3}[-.\s]?\d{1,14}",
    r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?:[-.\s]?(?:ext|x|ext.)[-.\s]?\d{1,5})?",
    r"\d{3}\.\d{3}\.\d{4}",
]

# ---------------------------------------------------------------------------
# Section headers and the ends of sections (matched at line start,
# case-insensitive, unless noted).
# ---------------------------------------------------------------------------
CERT_HEADER = r"^(?:certifications?|qualifications?|credentials?|professional\s+certifications?)\s*:?"
CERT_SECTION_END = (r"^(?:education|experience|skills|references|projects|awards|publications|"
                    r"languages|interests|hobbies)")
# experience headers are searched anywhere in the line
EXPERIENCE_HEADERS = [
    r"(?:professional\s+)?(?:work\s+)?experience",
    r"employment\s+history",
    r"work\s+history",
    r"career\s+history",
    r"professional\s+background",
    r"job\s+history",
    r"professional\s+experience",
    r"relevant\s+experience",
]
EXPERIENCE_SECTION_END = (r"^(?:education|skills|certifications|references|projects|awards|"
                          r"publications|languages|interests|hobbies|additional|profile|summary)")

# ---------------------------------------------------------------------------
# Certification line patterns.
# ---------------------------------------------------------------------------
CERT_NAME_ACRONYM = r"(.*?)\s*\(([A-Z]{2,})\)"
CERT_ACRONYM_NAME = r"([A-Z]{2,})\s*\((.*?)\)"
LIST_MARKER = r"^(?:•|\*|-|\d+\.|\–)\s+"
CERT_DATE = r"(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}|(?:\d{1,2}/\d{1,2}/\d{4}|\d{4}))"
CERT_STANDARD = (r"([\w\s\-\(\)]+?)(?:\s*[-–:]\s*|\s+by\s+|\s+from\s+)([\w\s\-\&\.]+)(?:,\s*|\s+|\s*\()"
                 r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}|(?:\d{1,2}/\d{1,2}/\d{4}|\d{4}))")
CERT_NUMBERED = (r"(?:certification|cert|certificate|license)(?:\s+(?:no|number|#|id|code))(?:\s*[:.]\s*|\s+)"
                 r"([\w\-]+)\s*(?:\)|,|\.|\s+)\s*(.*?)(?:\s+by\s+|\s+from\s+|\s*[-–:]\s*)([\w\s\-\&\.]+)")
CERT_BULLETED = (r"(?:•|\*|\-|\d+\.\s*)([\w\s\-\(\):]+?)(?:\s*[-–:]\s*|\s+by\s+|\s+from\s+|\s+issued\s+by\s+|\s*$)"
                 r"([\w\s\-\&\.]*)")
CERT_NUMBER_IN_NAME = r"\(([A-Z0-9\-]+)\)"
CERT_NUMBER_SHAPE = r"^[A-Z]+-[A-Z0-9]+$"
BULLET = r"^(?:•|\*|\-|\d+\.|\–)\s+"
PROVIDER_FIRST_LINE = r"(?:by|from|through|via)\s+([\w\s\-\&\.]+)(?:,|\s+|$)"
PROVIDER_NEXT_LINE = r"(?:by|from|through|via|issued by)\s+([\w\s\-\&\.]+)"
CERT_NUMBER_LINE = r"(?i)(?:certification|cert|certificate|license)(?:\s+(?:no|number|#|id|code))(?:\s*[:.]\s*|\s+)([\w\-]+)"

# ---------------------------------------------------------------------------
# Work history patterns.
# ---------------------------------------------------------------------------
DATE_RANGE_PATTERNS = [
    r"(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}\s*[-–—~to]*\s*(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}|Present|Current|Now|Ongoing))",
    r"(?:\d{1,2}/\d{4}\s*[-–—~to]*\s*(?:\d{1,2}/\d{4}|Present|Current|Now|Ongoing))",
    r"(?:\d{4}\s*[-–—~to]*\s*(?:\d{4}|Present|Current|Now|Ongoing))",
    r"(?:\d{1,2}/\d{1,2}/\d{4}\s*[-–—~to]*\s*(?:\d{1,2}/\d{1,2}/\d{4}|Present|Current|Now|Ongoing))",
]
COMPANY = r"(?:[A-Z][a-z]*\s*(?:Inc|LLC|Ltd|Co|Corp|Corporation|Company|Group))|(?:[A-Z][A-Z\s]+)"
TITLE = (r"([A-Z][a-zA-Z\s]{3,30}(?:Engineer|Developer|Manager|Director|Analyst|Designer|Consultant|"
         r"Specialist|Officer|Administrator|Coordinator|Lead|Head|Chief|Architect))")
LOCATION = r"(?:in|at)\s+([A-Za-z\s,]+)(?:$|[,.])"
ONGOING = r"(?i)present|current|now|ongoing"

# ---------------------------------------------------------------------------
# Scoring weights (similarity, education, certifications,
# experience, keywords), thresholds and the threshold sweep.
# ---------------------------------------------------------------------------
WEIGHTS_CASUAL = (0.35, 0.15, 0.05, 0.15, 0.30)
WEIGHTS_STRICT = (0.40, 0.20, 0.10, 0.15, 0.15)
LABEL_THRESHOLD_SKILLS = 0.18
LABEL_THRESHOLD_FULL = 0.28
DECISION_THRESHOLD_CASUAL = 0.25
DECISION_THRESHOLD_STRICT = 0.35
THRESHOLD_SWEEP = [0.15, 0.2, 0.25, 0.28, 0.3, 0.4]
EXPERIENCE_CAP_YEARS = 20
CERTIFICATION_SCALE = 10
EDUCATION_SCALE = 5

# ---------------------------------------------------------------------------
# Intake limits.
# ---------------------------------------------------------------------------
ALLOWED_EXTENSIONS = ["pdf", "doc", "docx"]
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_BATCH_BYTES = 20 * 1024 * 1024
