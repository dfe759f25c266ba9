"""Operators for preparing training data for language models.

Nothing else in ``beatlake`` imports this subpackage.
"""
