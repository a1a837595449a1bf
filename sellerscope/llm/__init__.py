"""Training-data operators: ten operators on `documents` and `pages`, and what they share."""
