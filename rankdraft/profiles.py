"""Parameter sets the registered queries and the tests run with."""

from rankdraft.config import JobConfig

DEFAULT = JobConfig()
OVERRIDE = JobConfig(
    override_manual=True,
    override_embedded=True,
    existing_desc_regex="old",
    existing_desc_required_words=("desc",),
    existing_desc_excluded_words=("2",),
)
# Every existing description may be changed.
REPLACE = JobConfig(override_manual=True, override_embedded=True)
STRICT = JobConfig(
    require_infobox=True,
    sole_infobox=True,
    required_words=("is",),
    excluded_words=("genus",),
    title_regex_tf=True,
    title_regex="gen",
)
LIMITS = JobConfig(max_arts=50, max_stage=20, write_examples=True, max_examples=5)
MAX_ARTS = JobConfig(max_arts=50)
MAX_STAGE = JobConfig(max_stage=20)
RANGE = JobConfig(partial=True, startpoint="Gen100", endpoint="Gen15")
LONG_NOUN = JobConfig(
    name_singular="alga of the northern hemisphere",
    name_plural="algae of the northern hemisphere",
)
WORDS = JobConfig(
    required_words=("is",), some_words=("alga", "moss"), text_regex_tf=True, text_regex="gen"
)
