"""Values shared by the operators."""

# The trait list, in the order that decides which failing trait is
# reported, and the settings used when a caller gives none.
CRITERIA = (
    "formality",
    "persuasiveness",
    "enthusiasm",
    "empathy",
    "filler words",
    "transition logic",
)
STRATIFY_BY = ("formality", "enthusiasm", "empathy")
THRESHOLD = 6
TRAIN_RATIO = 0.8
VAL_RATIO = 0.1
SEED = 42
MAX_TOKENS = 1024
IGNORE_INDEX = -100
