"""Readers and writers of the benchmark's folders."""

from lethe.sources.folders import (  # noqa: F401
    image_listing, load_split, read_classification_questions, read_generation_questions,
    read_id_list, read_json_folder, read_log, read_persons, read_split, read_training_profiles, write_eval_report,
    write_generation_results, write_id_lists, write_profile_stats, write_profiles, write_split,
)
from lethe.sources.checked import (  # noqa: F401
    bad_documents, checked_documents, good_documents, read_quarantine, write_quarantine,
)
from lethe.sources.listing import folder_files  # noqa: F401
