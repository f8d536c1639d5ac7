"""Operations of a pipeline for training data: ten operators and their queries."""
