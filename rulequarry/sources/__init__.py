"""Readers and writers of the file formats: transactions, folds, mined rules, result logs."""
