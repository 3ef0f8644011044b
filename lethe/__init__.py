"""lethe: Spark-native data side of a machine-unlearning benchmark.

Profiles and question files are read as declared-schema DataFrames, curated,
split into exact forget/retain sets, flattened, turned into prompts and padded
training batches; model outputs (generated text, step losses, per-token losses,
logits) come back as tables and are scored and aggregated into one report.
Everything is DataFrame code; Python runs only in Arrow batches (n-gram counts,
stemming, KL of logits).  ``lethe.llm`` holds the operators of a training-data
pipeline.
"""

__version__ = "0.2.0"
