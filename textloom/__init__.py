"""textloom: count-based language modelling and text-corpus analytics on Spark."""
