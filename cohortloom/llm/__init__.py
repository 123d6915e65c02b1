"""Training-data operators; each module documents its method, its defaults and what it does with odd rows."""
