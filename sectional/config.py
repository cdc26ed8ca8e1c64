"""Job parameters and fixed values.

Every constant here is a default for a function parameter; nothing reads a
global at run time except through a default argument.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# These must equal the reference's behaviour for equal results.
# ---------------------------------------------------------------------------

# Fixed lengths per field, <SOS> included.
SEQ_LENS = {"title": 16, "autho": 7, "abstr": 160, "intro": 512, "relat": 300, "metho": 800, "concl": 240}

VOCAB_SIZE = 40000
AUTHOR_VOCAB_SIZE = 1600
# Units of each field's recurrent encoder, width of the author embedding, units of the heads' first layer.
HIDDEN_SIZES = {"abstr": 64, "title": 32, "intro": 64, "relat": 64, "metho": 64, "concl": 64, "autho": 32}
AUTHOR_WIDTH = 64
HEAD_SIZE = 128
SPLIT_RATIOS = (0.6, 0.2, 0.2)
BATCH_SIZE = 48
EPOCHS = 20
PATIENCE = 5

# Special tokens and their indices (unknown, padding, start of sequence).
UNK, PAD, SOS = "<unk>", "<pad>", "<SOS>"
SPECIALS = [UNK, PAD, SOS]

# Label map: these venue values are the negative class; everything else
# (null included) is positive. Case-sensitive.
NEGATIVE_VENUES = ["CoRR", "No"]

# Corpus record fields and renames.
CORPUS_RENAMES = {"abstract": "abstr", "authors": "autho", "category": "categ"}

# Section flags: a heading containing one of these (lower case) belongs to the
# section. Lists are in the order the spans are appended.
INTRO_FLAGS = ["intro", "preli", "backg", "overv"]
RELAT_FLAGS = ["relat", "prior", "previo"]
CONCL_FLAGS = ["concl", "summa", "discu", "futur", "append", "applica"]

# Prefix extraction: heading must start with one of these (case-insensitive).
PREFIX_HEADINGS = ["Intro", "Relat", "Concl"]

# Characters deleted from a cleaned line, in the order they are removed.
DELETE_CHARS = ",.?!/$~\\{}#&@%^*-=[]+()"

# English stop words (179 words), applied to lower-cased tokens.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll",
    "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's",
    "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't",
    "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
]

# ---------------------------------------------------------------------------
# Our own definitions (not from the reference).
# ---------------------------------------------------------------------------

# Word tokeniser: runs of letters/digits/underscore, or one other non-space
# character. A defined regular expression, not a port of any NLP library.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"

# Headings used to derive a LaTeX view over the driver's plain-text documents.
LATEX_HEADINGS = ["Introduction", "Related Work", "Method", "Conclusion"]
