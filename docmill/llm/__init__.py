"""Training-data operators: deduplication, language-model scoring, decontamination, classifiers and source mixing.

Nothing else in the library imports this subpackage.
"""
