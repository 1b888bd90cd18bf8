"""Fixed values shared by the Spark operators and the SQL oracle."""

# English stop words (the list shipped with Spark's
# StopWordsRemover, 181 entries, in its natural order).
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd "
    "you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
    "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's "
    "let's ought that's there's what's when's where's who's why's would"
).split()

# Extra stop words removed after cleaning in the TF-IDF path.
EXTRA_STOP_WORDS = ["get", "would", "got", "us", "also", "even", "ive", "im"]

# Fused forms the word tokeniser splits in two.
FUSED_FORMS = {"cannot": "can not", "gimme": "gim me", "gonna": "gon na",
               "gotta": "got ta", "lemme": "lem me", "wanna": "wan na"}

# Regular expressions (same text is valid Java and RE2).
ASCII_PUNCT_RE = r"[!-/:-@\[-`{-~]"            # the 32 ASCII punctuation marks
DIGITS_RE = r"[0-9]"
PUNCT_OR_DIGIT_RE = r"[!-/:-@\[-`{-~0-9]"      # the two classes above in one pass
# Blanks that Python's str.split() splits on.
WHITESPACE_RE = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]+"
SPACE_BY_SYMBOLS_RE = r"[/(){}\[\]\|@,;]"
BAD_SYMBOLS_RE = r"[^0-9a-z #+_]"
# Word tokens of at least two characters (letters, digits, underscore; Unicode).
WORD2_RE = r"[\p{L}\p{N}_]{2,}"

# Count bucket edges {0}, {1}, [2,5), [5,inf) and representatives.
COUNT_BUCKETS = [0, 1, 2, 5]

# Sentiment normalisation constant, compound = s / sqrt(s^2 + 15).
SENTIMENT_ALPHA = 15.0
