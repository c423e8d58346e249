"""Job parameters. One frozen value object, passed explicitly to every plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JobConfig:
    """All settings of a staging or edit run; the defaults accept every page.

    Regexes are matched from the start of the value and ignore case. An empty
    string in a word list matches everything, an empty list switches it off.
    """

    mode_flag: str = "edit"

    # Wording of the drafts
    name_singular: str = "alga"
    name_plural: str = "algae"

    # Which rows of the target list are processed (0 = no limit)
    max_arts: int = 0
    max_stage: int = 0
    partial: bool = False
    startpoint: str = ""
    endpoint: str = ""

    # Target source: a TSV list, or the members of a category
    use_basefile: bool = True
    base_file: str = ""
    targetcat: str = ""
    recurse_cats: bool = True

    # Which pages are wanted; other pages are skipped and not recorded
    require_infobox: bool = False
    infobox_strings: tuple[str, ...] = ("Speciesbox", "Taxobox")
    sole_infobox: bool = False

    # Criteria for the lead and title; failures are recorded
    required_words: tuple[str, ...] = ("",)
    some_words: tuple[str, ...] = ()
    excluded_words: tuple[str, ...] = ()
    text_regex_tf: bool = False
    text_regex: str = ""
    title_regex_tf: bool = False
    title_regex: str = ""

    # Staging output
    staging_file: str = ""
    write_examples: bool = False
    max_examples: int = 200

    # Existing descriptions, for staging and editing alike
    override_manual: bool = False
    override_embedded: bool = False
    existing_desc_required_words: tuple[str, ...] = ("",)
    existing_desc_excluded_words: tuple[str, ...] = ()
    existing_desc_regex: str = ""

    # Accounts: edits made by ``bot_user`` name it in the edit summary
    username: str = "descbot"
    bot_user: str = "descbot"

    # What a staged title that is not in canonical form does: one error row, or
    # an exception for the whole run ("fail")
    on_mismatch: str = "error"

    @property
    def base_path(self) -> str:
        return self.base_file or f"base_file {self.name_plural}.tsv"

    @property
    def staging_path(self) -> str:
        return self.staging_file or f"staged {self.name_plural}.tsv"
