"""tallyline.plans"""
