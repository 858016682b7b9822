"""Word lists, patterns and thresholds that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: keywords by language
JAVASCRIPT_KEYWORDS = (
    "function return if else for while do switch case break continue class extends new this super try catch finally "
    "throw const let var import export default from async await yield typeof instanceof in of delete void null "
    "undefined true false static get set"
).split()
TYPESCRIPT_ONLY = "interface type enum implements public private protected readonly namespace declare as is keyof infer".split()
TYPESCRIPT_SEARCH_ONLY = "abstract satisfies".split()
PYTHON_KEYWORDS = (
    "def return if elif else for while break continue class try except finally raise import from as with lambda yield "
    "async await in is not and or pass global nonlocal assert del None True False self"
).split()

# fixed values: path patterns (case-insensitive)
SKIPPED_PATH = r"(?i)(^|/)(node_modules|vendor|third_party|__pycache__|\.git)(/|$)|\.d\.[cm]?ts$|\.min\.[cm]?js$|[.-]bundle\.[cm]?js$"
AUXILIARY_PATH = r"(?i)(^|/)(tests?|__tests__|spec|specs|e2e|bench(mark)?s?|examples?|demos?|docs?|scripts?|tools?)(/|$)|\.(test|spec|bench)\.[a-z]+$|(^|/)(test_[^/]*|[^/]*_test)\.py$|(^|/)(conftest|setup|noxfile)\.py$"
AUXILIARY_SCAN_PATH = r"(?i)(^|/)(tests?|__tests__|spec|specs|e2e|bench(mark)?s?|examples?|demos?|docs?|scripts?|tools?|\.github)(/|$)|\.(test|spec|bench)\.[a-z]+$|(^|/)(test_[^/]*|[^/]*_test)\.py$|(^|/)(tests?|bench(mark)?s?|examples?)\.[a-z]+$|\.config\.[a-z]+$|(^|/)(setup|conftest)\.py$"
DERIVED_PATH = r"(?i)(^|/)(dist|build|umd|cjs|esm|lib-cov|out|bundle|compiled)(/|$)"
EXCLUDED_SEGMENTS = "node_modules vendor vendors dist build coverage .next .nuxt .venv venv __pycache__ generated fixtures snapshots".split()
# fixed values: directories, suffixes of texts and of code as the hosted scan takes them (case-sensitive directories)
IGNORED_SEGMENTS = "node_modules dist build vendor .git .next target out coverage .venv venv __pycache__ .cache".split()
TEXT_SUFFIXES = ".js .jsx .mjs .cjs .ts .tsx .py .go .rs .rb .java .c .h .cpp .cc .cs .php .json .md .txt .toml .yaml .yml .lock".split()
CODE_SUFFIXES = ".js .jsx .mjs .cjs .ts .tsx .mts .cts .py .go .rs .rb .java .c .h .cpp .cc .cs .php .swift .kt".split()
GENERATED_HEAD = r"(?m)^\s*// *@generated|^\s*# *(generated|auto-generated)|DO NOT EDIT"

# fixed values: ranking weights
RANK_WEIGHTS = {"origin": 2.5, "authority": 1.0, "name_match": 1.5, "primary_source": 0.8, "derived": -2.0, "auxiliary": -1.0, "vendored": -3.0, "license_known": 0.3}


@dataclass(frozen=True)
class Profile:
    """Shingle and winnowing sizes of one of the two engines."""

    k: int
    window: int


SOURCE_SEARCH = Profile(k=7, window=4)
PIPELINE = Profile(k=5, window=4)


# fixed values: thresholds of the source search
@dataclass(frozen=True)
class SearchSettings:
    """Retrieval and evidence thresholds of the source search."""

    region: int = 120
    stride: int = 60
    shortlist: int = 20
    padding: int = 60
    common_df: float = 0.60
    common_weight: float = 0.20
    strong_matched: int = 24
    strong_run: int = 12
    strong_coverage: float = 0.60
    possible_matched: int = 12
    possible_run: int = 7
    possible_coverage: float = 0.35
    strong_common_ratio: float = 0.75
    specific_matched: int = 18
    specific_run: int = 9
    rare_hashes: int = 3
    contiguous_run: int = 30
    renamed_run: int = 80
    renamed_kinds: int = 14


# fixed values: thresholds of the edit classifier
@dataclass(frozen=True)
class EditThresholds:
    """Shape thresholds of the edit classifier."""

    bulk_lines: int = 8
    bulk_ms: int = 400
    human_chars: int = 40
    human_ms: int = 150
    imported_chars: int = 400
