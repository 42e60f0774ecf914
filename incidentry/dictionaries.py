"""Default dictionaries.  Every operator takes its dictionary as an argument.

Tables of ``fixed`` are the data model's.  The terms of keyword categories and of the
product ontology are data that the user loads (``sources.dictionaries``); the defaults here
are made by rule from the names, with a few words of our own.
"""

from __future__ import annotations

from .fixed import (  # noqa: F401
    BOOTSTRAP,
    CAUSAL,
    CHECKS,
    DEFAULT_WEIGHT,
    DIMENSION_WEIGHTS,
    DIMENSIONS,
    DISTRESS,
    EFFECTIVENESS,
    FALLBACK,
    FRAMEWORKS,
    HINTS,
    JURISDICTIONS,
    KEYWORD_GROUPS,
    LEGACY_PARENTS,
    MISMATCH,
    MITIGATIONS,
    NO_RISK_WEIGHT,
    PAIR_EFFECTIVENESS,
    PAIRS,
    PARENT_PATTERNS,
    PRINCIPLES,
    PROTECTIVE,
    QUESTIONS,
    RELEVANCE,
    RISK_WEIGHTS,
    RISKY,
    SECTORS,
    SENSITIVITY,
    SENTIMENTS,
    SEVERITIES,
    SLUGS,
    SOLOVE_WORDS,
    TAXONOMY,
    WEIGHTS,
)

#: Keyword categories in tie order, with words of our own beside the name.
_OWN_WORDS: dict[str, tuple[str, ...]] = {
    "surveillance": ("hidden microphone", "watched by", "followed around"),
    "interrogation": ("asked under pressure", "intrusive questions"),
    "aggregation": ("combined records", "joined databases"),
    "identification": ("singled out", "named individuals"),
    "model_inversion": ("reconstructed training examples",),
    "training_data_extraction": ("regurgitated records",),
    "synthetic_media_misuse": ("cloned voice", "forged video"),
    "provenance_failure": ("unknown origin",),
    "insecurity": ("ransomware", "open bucket", "weak password", "unencrypted"),
    "secondary_use": ("used for something else", "without consent"),
    "exclusion": ("no way to object", "black box"),
    "breach_of_confidentiality": ("broken promise of secrecy",),
    "disclosure": ("handed over", "made known"),
    "increased_accessibility": ("posted online", "searchable"),
    "blackmail": ("extortion", "ransom demand"),
    "appropriation": ("identity theft", "impersonation"),
    "distortion": ("inaccurate", "false claims"),
    "intrusion": ("unsolicited", "spam"),
    "decisional_interference": ("nudged into", "forced consent", "dark pattern"),
    "data_handling": ("never deleted", "excessive collection"),
    "regulatory_violation": ("fined by", "gdpr", "penalty"),
}
CATEGORIES: dict[str, tuple[str, ...]] = {name: (name.replace("_", " "), *words) for name, words in _OWN_WORDS.items()}
THRESHOLD = 1.0

SUBTYPE_PARENT = {s: p for p, subs in TAXONOMY.items() for s in subs}
#: Parents map to themselves, subtypes and the labels of older files to their parent.
PARENT_OF = {p: p for p in TAXONOMY} | SUBTYPE_PARENT | LEGACY_PARENTS
#: The categories for which a cascade asks questions: all subtypes.
CASCADE = tuple(SUBTYPE_PARENT)


def slug_terms(slug: str) -> tuple[str, tuple[str, ...], str | None]:
    """The default entry of a slug: its words with spaces, hyphens or nothing between; turned round with ``of``, and with a word between."""
    words = slug.split("_")
    terms = (" ".join(words), "-".join(words), "".join(words)) if len(words) > 1 else (slug,)
    return slug, terms, rf"\b{words[-1]} of {' '.join(words[:-1])}\b|\b{words[0]} [a-z]+ {' '.join(words[1:])}\b" if len(words) > 1 else None


#: Product features: slug, substrings, regular expression or None.
ONTOLOGY: tuple[tuple[str, tuple[str, ...], str | None], ...] = tuple(slug_terms(s) for s in SLUGS)

GENERAL = "general_privacy_concern"
#: Effectiveness against a risk of a pair that has no score of its own.
PRIMARY_EFFECT, SECONDARY_EFFECT = 0.7, 0.5

#: Rules: id, text, jurisdictions, sectors, languages, tags, source, priority.
RULES = tuple(
    (f"r{i:02d}", f"Rule {i}: state the purpose before collecting {what}", j, s, lang, (what,), src, p)
    for i, (what, j, s, lang, src, p) in enumerate(
        [
            ("health data", ("EU", "UK"), ("health",), (), "gdpr", 1.0), ("card data", (), ("finance",), ("en",), "pci", 1.0), ("video", ("UK",), ("smart_home",), ("en",), "ico", 0.8), ("children data", ("US",), ("children_edtech",), (), "coppa", 1.2),
            ("location", ("FR",), (), ("fr",), "cnil", 0.5), ("contacts", (), (), (), "nist", 1.0), ("biometrics", ("CA", "EU"), (), (), "pipeda", 0.9), ("cookies", ("EU", "FR", "ES"), (), (), "edpb", 0.4), ("purchases", ("BR",), ("finance",), ("pt",), "lgpd", 0.7),
            ("messages", (), (), ("en", "de"), "nist", 0.6), ("device ids", ("US",), (), (), "ftc", 0.3), ("search logs", (), ("health", "finance"), (), "hipaa", 0.2), ("payroll", ("ES",), ("finance",), (), "aepd", 1.5), ("voice", ("UK", "CA"), ("smart_home",), (), "opc", 1.0),
        ],
        1,
    )
)

SOURCES = ("regulator", "news", "breach_report", "court", "forum")
#: Invented incident texts; chosen so that every detector has hits, misses, ties and several hits.
PHRASES = (
    "Hackers used ransomware and stolen files were leaked due to an unencrypted backup disk",
    "The doorbell camera kept tracking visitors and location data was sold to brokers without consent after third party sharing",
    "A hospital exposed medical records because of an open bucket, and patients were worried",
    "Users faced a dark pattern with forced consent and no user control in the deceptive interface of dark patterns",
    "Regulators issued a gdpr fine after a data breach was disclosed late, the ico said",
    "Profiling users with combined records in opaque algorithms led to inaccurate scores",
    "Forged video with a cloned voice enabled impersonation and identity theft",
    "Spam and unsolicited messages, unwanted and often harassed calls, made people angry",
    "The company could not explain the provenance failure of text of unknown origin",
    "Scraping raised model inversion and training data extraction concerns with regurgitated records",
    "Blackmail and extortion followed; victims were afraid and deleted account after account",
    "The bank lost credit card numbers as a result of weak password rules, a breach of confidentiality",
    "Students found school profiles posted online in a searchable table, an increased accessibility",
    "Facial recognition and fingerprint scans were collected, a biometric secondary use and collection of biometric traits",
    "An interrogation with intrusive questions, asked under pressure, preceded the order",
    "There is no retention rule and records were never deleted, excessive collection caused by old scripts and default opt in",
    "The webcam access came with session replay and always-on-listening that resulted in complaints",
    "Aggregation of dark patterns in several places did not concern anyone here",
    "Breaches were reported, and hackathons were held in france following long talks",
    "Manipulation and decisional interference, triggered by misleading prompts in the smart home app, nudged into buying",
    "End-to-end-encryption and data minimization with multi factor auth protect the private message archive",
    "A complaint and an enforcement order asked for one million in penalty payments in canada",
    "Data broker usage with behavioral ads used gps and location tracking, hidden data collection and no encryption",
    "The weather was calm and the meeting ended early",
)
