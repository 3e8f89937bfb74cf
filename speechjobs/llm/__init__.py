"""Operations on document corpora for language-model training data."""
