"""Search over large stores of conversational memory, as Spark DataFrame plans."""
