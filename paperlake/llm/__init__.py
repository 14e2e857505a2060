"""Operations of a training-data pipeline: mixing, filtering, de-duplication, search, scoring, tokens.

Nothing else in the package imports this subpackage. Operators live in one module each;
``queries`` registers one thin query per operator.
"""
