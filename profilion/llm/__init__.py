"""Operations on training text: ten operators, their queries and the corpus pipeline's stages."""
