"""Fixed values.

Everything in this module must equal the values the studied scripts use, or the
results differ: rule word lists, the ordered domain map, seeds, split shares,
prompt texts, class names and significance cut-offs. They are kept here, in
their natural order, as plain text. Every operator takes them as parameters
with these as defaults, so other lists can be passed without code changes.
"""

# --- claim rules -------------------------------------------------------------
# Hedge phrases: a lower-cased text containing any of them (as a substring) is
# not a claim.
HEDGE_PHRASES = ["i think", "maybe", "probably", "in my opinion", "imo", "idk", "guess"]

# Auxiliary verbs: a claim must contain one of them as a whole word.
AUX_VERBS = ["is", "are", "was", "were", "has", "have", "had", "will", "can", "should", "must"]

# Language code a post must carry in its `langs` list.
ENGLISH_CODE = "eng"

# Ordered domain map: the first domain with any keyword (substring of the
# lower-cased text) wins; no hit gives null.
DOMAIN_KEYWORDS = {
    "Health": ["vaccine", "covid", "virus", "health", "disease", "cancer", "doctor", "mask"],
    "Politics": ["election", "government", "president", "biden", "trump", "vote", "policy", "minister"],
    "War": ["war", "ukraine", "russia", "israel", "hamas", "army", "soldier", "conflict", "attack"],
}

# Keyword baseline: any of these in the lower-cased claim predicts 0 (false).
SUSPICIOUS_KEYWORDS = ["breaking", "shocking", "revealed", "secret", "you won't believe"]

# --- experiment set-up -------------------------------------------------------
RUN_SEEDS = [42, 123, 456, 789, 999]
N_RUNS = 5
TEST_SHARE = 0.3
BASELINE_SEED = 42          # the random baseline of the split evaluation always uses 42
INNER_TEST_SHARE = 0.2      # optional inner split of the TF-IDF baseline
TFIDF_MAX_FEATURES = 1000
TFIDF_NGRAM_RANGE = (1, 2)
LR_MAX_ITER = 1000
LR_TOLERANCE = 1e-4        # stopping tolerance of the logistic regression (library default)
BOOTSTRAP_RESAMPLES = 1000
CONFIDENCE_LEVEL = 0.95
ENCODER_MAX_LENGTH = 512

# Datasets and condition names as they appear in the metric records.
DATASETS = ["UGC", "NGC"]
MODEL_CONDITION = "Model"

# Confidence levels in the order they are searched for.
CONFIDENCE_LEVELS = ["high", "medium", "low"]
UNKNOWN_CONFIDENCE = "Unknown"

# Verifiability answers.
VERIFIABLE = "Verifiable"
NOT_VERIFIABLE = "Not Verifiable"
ERROR_LABEL = "Error"
VERIFY_RETRIES = 3

# Significance stars: p below the first bound gets the first mark, and so on.
SIGNIFICANCE_LEVELS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]
NOT_SIGNIFICANT = "ns"

# Claim-length quartile names (lowest first).
LENGTH_BIN_NAMES = ["Short", "Medium", "Long", "Very Long"]

# Error analysis: examples kept per kind, examples shown, characters shown.
ERROR_EXAMPLES = 5
PREVIEW_CHARS = 100

# Tokens pandas' CSV reader turns into missing values.
CSV_NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                   "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# --- prompt texts (verbatim, including the "true of false" wording) ----------
SHORT_PROMPT_HEAD = "Classify the following "
SHORT_PROMPT_MID = ' claim as true of false: "'
SHORT_PROMPT_TAIL = '"  \nAnswer:'

STRUCTURED_PROMPT_HEAD = (
    "You are a fact-checking assistant. Your task is to determine whether the given claim is factually "
    "accurate or not.\n\nContext: This claim appeared in "
)
STRUCTURED_PROMPT_MID = ' content.\nClaim: "'
STRUCTURED_PROMPT_TAIL = (
    '"\n\nInstructions:\n'
    '- Classify the claim as either "True" or "False" based on factual accuracy\n'
    '- Indicate your confidence level as "High", "Medium", or "Low"\n'
    "- Provide a brief justification for your decision\n\n"
    "Format your response exactly as follows:\n"
    "Classification: [True/False]\n"
    "Confidence: [High/Medium/Low]\n"
    "Justification: [Brief explanation]"
)

VERIFY_PROMPT_HEAD = (
    "\n    Determine if the following tweet contains a factual, verifiable claim\n"
    "    (something that could be proven True or False by checking evidence)\n"
    "    or if it is non-verifiable (e.g., opinion, vague, emotional, rhetorical).\n\n"
    '    Respond with only one word: "Verifiable" or "Not Verifiable".\n\n'
    '    Tweet: "'
)
VERIFY_PROMPT_TAIL = '"\n    '
