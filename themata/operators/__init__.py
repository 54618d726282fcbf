"""The dataset-level steps: vocabulary, sampling, joins, E-step, M-step, bound, scoring."""
