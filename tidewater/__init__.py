"""tidewater: customer analytics and training-data operators as Spark plans."""
