"""Stop words by language: English and Arabic lists that are fixed values, Spark's own lists for others, and lists that are given."""

#: fixed value: the English stop words, in their usual order
ENGLISH = """
a an the and or but if then else of in on at to for with without by from up down out off over under again further is am are was were be been
being do does did doing have has had having this that these those it its as so than too very can will just don should now i you he she we they
them his her their our your my me him us not no nor only own same such both each few more most other some any all there here when where
why how what which who whom
""".split()

#: fixed value: the Arabic stop words, in their usual order
ARABIC = """
في من إلى على و أن إن هذا هذه ذلك تلك التي الذي الذين هو هي هم هن أنت أنتم أنا نحن كان كانت يكون تكون لم لا لن ما مع عن بعد قبل عند كل بعض غير
إذا حتى ثم أو لكن كما قد لقد إلا أي هناك الآن حيث بين فوق تحت أمام خلف حول
""".split()

NONE: list[str] = []

#: languages on offer, and the names under which Spark has their lists
LANGUAGES = {"none": None, "en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "nl": "dutch", "pt": "portuguese", "ru": "russian", "ar": None}


def words(language: str = "en", lists: dict[str, list[str]] | None = None) -> list[str]:
    """The stop words of a language, lower-cased; `none` has none. `lists` come first: other languages, or other words."""
    if lists and language in lists:
        return list(dict.fromkeys(w.lower() for w in lists[language]))
    if language in (own := {"none": NONE, "en": ENGLISH, "ar": ARABIC}):
        return own[language]
    if not LANGUAGES.get(language):
        raise ValueError(f"no stop words for {language!r}: give a list")
    from pyspark.ml.feature import StopWordsRemover

    return list(dict.fromkeys(w.lower() for w in StopWordsRemover.loadDefaultStopWords(LANGUAGES[language])))
